"""The pipeline stage by stage against plain versions, and what is registered."""

from collections import Counter

import brute
import compare
import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from reporank.llm import oracle, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_sql_twins(spark, name):
    con = compare.connect(FOLDER)
    got = compare.spark_rows(queries.REGISTERED[name](spark, FOLDER))
    assert not compare.differences(got, compare.sql_rows(con, oracle.statements()[name]))


def test_stages(spark, tmp_path):
    """Every stage is judged on what the one before it wrote."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    texts = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]

    before, after = seen["toxicity"]
    model = toxicity.trained(before, labels)
    want = [(i, t) for i, t in texts(before) if not (model.reached(t)[:1] >= toxicity.REJECT_AT).any()]
    assert texts(after) == want and len(want) < len(texts(before))

    before, after = seen["line_dedup"]
    keep = brute.line_keepers(texts(before))
    want = [
        (i, "\n".join(x for n, x in enumerate(t.split("\n")) if keep.get((i, n), (i, n)) == (i, n)))
        for i, t in texts(before)
    ]
    assert texts(after) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen["near_dedup"]
    group = brute.simhash(texts(before))
    assert [i for i, _ in texts(after)] == sorted({g for _, g in group.values()})

    before, after = seen["decontamination"]
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    assert [i for i, _ in texts(after)] == [i for i, _, hit, *_ in brute.leaks(texts(before), items) if not hit]

    before, after = seen["packing"]
    first = Counter(r.doc_id for r in after.filter("start = 0").collect())
    assert first == Counter(r.doc_id for r in before.collect())


def test_run_takes_all_stages(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0
