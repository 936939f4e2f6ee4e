"""Run one registered query and its SQL twin and compare the rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _sorted([tuple(r) for r in df.collect()], df.columns)


def sql_rows(con, statement):
    done = con.execute(statement)
    columns = [c[0] for c in done.description]
    return _sorted(done.fetchall(), columns)


def differences(left, right):
    """Human-readable differences, empty when the results are the same."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} rows differ: {str(bad[:2])[:600]}" if bad else ""
