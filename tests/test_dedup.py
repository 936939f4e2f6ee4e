import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reporank import fixed
from reporank.operators import dedup as D
from reporank.operators import components as G
from reporank.operators.components import connected_components
from reporank.operators.skew import join_lookup


def component_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("held", [20, 500_000])
def test_components(spark, held):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1025)]
    star = [(2000, 2000 + i) for i in range(1, 300)]
    rest = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges = chain + star + rest
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.component for r in connected_components(df.repartition(6), "x", "y", held).collect()}
    assert got == component_of([(a, b) for a, b in edges if a != b])


def test_a_task_hands_on_its_forest_before_it_holds_all_edges():
    """What a union-find holds is bounded by nodes, not by the edges of its task."""
    rng, read = random.Random(4), []
    edges = [(f"{a:05}", f"{b:05}") for a, b in ((rng.randrange(3000), rng.randrange(3000)) for _ in range(4000))]

    def batches():
        for start in range(0, len(edges), 100):
            read.append(start)
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges[start : start + 100]])

    found, held = [], 0
    for batch in G._forest(500)(batches()):
        held = held or len(read)
        found += zip(*(c.to_pylist() for c in batch.columns))
    assert held <= 6  # 500 nodes are there after five batches or six
    named, whole = component_of(found), component_of([(a, b) for a, b in edges if a != b])
    assert named == whole


def test_lookup_join_splits_hot_keys(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v int")
    lookup = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = join_lookup(df, lookup.filter("k <> 'k7'"), ["k"], "n")
    assert got.columns == ["k", "v", "top"]
    assert got.count() == 999
    assert got.filter("k = 'hot' AND top = 899").count() == 900


def test_lookup_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, v int")
    lookup = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    got = {(r.k, r.v, r.total) for r in join_lookup(df, lookup, ["k"], "n").collect()}
    assert got == {(None, 1, 3), (None, 2, 3), ("a", 3, 3), ("b", 4, 4)}


def test_a_hot_key_is_dealt_out(spark):
    """Without adaptive execution, half of all rows under one key still reach all tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") < 20_000, -1).otherwise(F.col("id"))
        rows = spark.range(40_000).withColumn("k", key)
        lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = join_lookup(rows, lookup, ["k"], "n")
        sizes = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in sizes) == 40_000
    assert max(r.n for r in sizes) < 14_000


def fingerprint(rng, base=None, bands=0):
    """Random fingerprint that shares its first ``bands`` bands with ``base``."""
    own = [rng.randrange(1 << 31) for _ in range(fixed.NUM_HASHES)]
    cut = bands * fixed.BAND_ROWS
    return (base[:cut] if base else []) + own[cut:]


def repos(seed=4, n=60):
    rng = random.Random(seed)
    prints = []
    for _ in range(n):
        kind = rng.randrange(4)
        base = rng.choice(prints) if prints and kind else None
        prints.append(list(base) if base and kind == 1 else fingerprint(rng, base, 3 * bool(kind)))
    rows = [(f"r{i:03}", rng.randrange(5), fp) for i, fp in enumerate(prints)]
    rows += [("none", 9, None), ("nil", 9, []), ("blank1", 1, [fixed.EMPTY_MINIMUM] * 128),
             ("blank2", 2, [fixed.EMPTY_MINIMUM] * 128)]
    rng.shuffle(rows)
    return rows


def buckets(rows):
    out = {}
    for name, stars, fp in rows:
        if fp and min(fp) < fixed.EMPTY_MINIMUM:
            for b in range(16):
                out.setdefault((b, tuple(fp[b * 8 : b * 8 + 8])), []).append((-stars, name))
    return [sorted(members) for members in out.values()]


def expected(rows, rule):
    groups = buckets(rows)
    everyone = {m for g in groups for m in g}
    if rule == "any_band":
        kept = {g[0] for g in groups}
    else:
        label = component_of([(g[0], m) for g in groups for m in g])
        kept = {min(m for m in everyone if label[m] == c) for c in set(label.values())}
    return {name for _, name in everyone - kept}


SCHEMA = "full_name string, stars long, minhash_fingerprint array<long>"


@pytest.mark.parametrize("rule", ["any_band", "cluster"])
def test_dedup_matches_brute_force(spark, rule):
    rows = repos()
    df = spark.createDataFrame(rows, SCHEMA)
    got = D.dedup(df, rule)
    assert got.count() == len(rows)
    assert {r.full_name for r in got.filter("is_duplicate").collect()} == expected(rows, rule)
    assert expected(rows, "any_band") <= expected(rows, "cluster")


@pytest.mark.parametrize("rule", ["any_band", "cluster"])
def test_dedup_does_not_depend_on_row_order(spark, rule):
    rows = repos(5)
    first = D.dedup(spark.createDataFrame(rows, SCHEMA), rule).filter("NOT is_duplicate")
    kept = {r.full_name for r in first.collect()}
    again = D.dedup(spark.createDataFrame(sorted(rows, key=lambda r: r[0]), SCHEMA), rule)
    assert {r.full_name for r in again.filter("NOT is_duplicate").collect()} == kept


def test_clustered_survivors_survive_again(spark):
    survivors = D.dedup(spark.createDataFrame(repos(6), SCHEMA)).filter("NOT is_duplicate")
    again = D.dedup(survivors.drop("is_duplicate"))
    assert again.filter("is_duplicate").count() == 0


def test_equal_stars_are_broken_by_name(spark):
    fp = fingerprint(random.Random(7))
    df = spark.createDataFrame([("b", 3, fp), ("a", 3, fp), ("c", None, fp)], SCHEMA)
    for rule in ("any_band", "cluster"):
        got = {r.full_name: r.is_duplicate for r in D.dedup(df, rule).collect()}
        assert got == {"a": False, "b": True, "c": True}


def test_a_bucket_with_most_rows(spark):
    rng = random.Random(8)
    base = fingerprint(rng)
    rows = [(f"n{i:04}", i % 7, fingerprint(rng, base, 1)) for i in range(300)]
    rows += [(f"copy{i:04}", 0, base) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    links = D.candidate_pairs(df)
    pairs = {(r.keeper, r.duplicate): r.bands for r in links.collect()}
    assert len(pairs) == 599  # every repo but the one overall keeper hangs on one other
    assert pairs["copy0000", "copy0123"] == 16
    assert pairs["n0006", "n0000"] == 1
    kept = D.dedup(df).filter("NOT is_duplicate").collect()
    assert [r.full_name for r in kept] == ["n0006"]
    checked = D.verify_pairs(links, df)
    assert checked.filter("bands = 16 AND jaccard < 1").count() == 0


def test_flags_per_bucket(spark):
    rows = repos(9)
    flags = D.bucket_flags(spark.createDataFrame(rows, SCHEMA)).collect()
    flagged = sorted(r.full_name for r in flags if r.is_duplicate)
    assert flagged == sorted(name for g in buckets(rows) for _, name in g[1:])
    assert len(flags) == sum(map(len, buckets(rows)))


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        D.dedup(spark.createDataFrame([], SCHEMA), "first")
