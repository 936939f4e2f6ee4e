"""The stored vector index: recall, pruning, appends; exact search stays the default."""

import re

import numpy as np
import pytest

from reporank.operators import vector_index as X
from reporank.operators.nearest import nearest_stored
from reporank.plans.search import search

DIMS = 16
VECTOR = "array<double>"


def cloud(seed, n, clusters=40):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(clusters, DIMS))
    return [(centres[rng.integers(clusters)] * 2 + rng.normal(size=DIMS) * 0.35).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    stored = [(f"j{i:04}", v) for i, v in enumerate(cloud(1, 1500))] + [("zero", [0.0] * DIMS), ("none", None)]
    asked = [(i, v) for i, v in enumerate(cloud(2, 400))] + [(900, [0.0] * DIMS), (901, None), (902, [])]
    return (
        spark.createDataFrame(asked, f"query_id long, embedding {VECTOR}").repartition(3),
        spark.createDataFrame(stored, f"job_id string, embedding {VECTOR}").repartition(5),
    )


def rows(df):
    return {r.query_id: (r.job_id, pytest.approx(r.similarity)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "all")
    X.build_index(tables[1], folder, cells=24)
    return folder


def test_all_cells_probed_is_exact(tables, index):
    incoming, stored = tables
    want = rows(nearest_stored(incoming, stored, threshold=0.9))
    assert len(want) > 200
    assert rows(X.nearest_indexed(incoming, index, threshold=0.9, probes=24)) == want


def test_recall_of_few_probes(tables, index):
    seen = []
    for probes in (1, 4, 8):
        found = X.recall(*tables, index, probes=probes, threshold=0.9).first()
        assert found.recall == found.found / found.wanted
        seen.append(found.recall)
    assert seen == sorted(seen) and seen[1] >= 0.95 and seen[2] >= 0.99


def test_hits_are_true(tables, index):
    """What a few probes return is never better than the exact answer, and its similarity is right."""
    exact = {r.query_id: r.similarity for r in nearest_stored(*tables, threshold=0.9).collect()}
    for r in X.nearest_indexed(tables[0], index, threshold=0.9, probes=2).collect():
        assert r.similarity <= exact[r.query_id] + 1e-9


def test_appends_do_not_train_again(spark, tables, index, tmp_path):
    incoming, stored = tables
    folder = str(tmp_path / "grown")
    X.build_index(stored.filter("job_id < 'j0700'"), folder, cells=24)
    before = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    X.append_index(stored.filter("job_id >= 'j0700' AND job_id < 'j1100'"), folder)
    X.append_index(stored.filter("job_id >= 'j1100'"), folder)
    X.append_index(stored.filter("false"), folder)
    assert spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect() == before
    assert X.stored_vectors(spark, folder).count() == 1500
    assert sum(r.n for r in X.index_cells(spark, folder).collect()) == 1500
    want = rows(nearest_stored(incoming, stored, threshold=0.9))
    assert rows(X.nearest_indexed(incoming, folder, threshold=0.9, probes=24)) == want


def test_only_probed_cells_are_read(spark, tables, index):
    one = tables[0].filter("query_id = 3")
    probing = one.select("embedding").first().embedding
    means = np.array([r.v for r in spark.read.parquet(f"{index}/centroids").orderBy("cell").collect()])
    near = set(np.argsort(-(means @ probing))[:3].tolist())
    read = X.stored_vectors(spark, index).filter("cell IN (%s)" % ",".join(map(str, near)))
    files = {f for f in read.inputFiles()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert {int(re.search(r"cell=(\d+)", f)[1]) for f in files} <= near | set(range(24))
    seen = []
    original = X.tiled_hits

    def spied(housed, *rest):
        seen.append(housed._jdf.queryExecution().executedPlan().toString())
        return original(housed, *rest)

    X.tiled_hits = spied
    try:
        X.nearest_indexed(one, index, probes=3).collect()
    finally:
        X.tiled_hits = original
    asked = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)", seen[0])
    assert set(map(int, asked[1].split(","))) == near


def test_search_uses_the_index_when_told(spark, tables, index):
    incoming, stored = tables
    incoming = incoming.filter("size(embedding) > 0").selectExpr("query_id", "'some words' AS text", "embedding")
    exact = search(incoming, stored, any_status=True)
    probed = search(incoming, stored, any_status=True, index=index, probes=24)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, probed.collect()))
    done = [("j0003", "done", 1), ("j0004", "failed", 2), ("j0005", "done", 3)]
    events = spark.createDataFrame(done, "job_id string, status string, seq long").selectExpr(
        "*", "timestamp_seconds(seq) AS updated_at"
    )
    some = search(incoming, stored, events, index=index, probes=24)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, search(incoming, stored, events).collect()))


def test_corner_cases(spark, tmp_path):
    empty = spark.createDataFrame([], f"job_id string, embedding {VECTOR}")
    with pytest.raises(ValueError):
        X.build_index(empty, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        X.build_index(empty, str(tmp_path / "none"), cells=0)
    same = spark.createDataFrame([(f"a{i}", [1.0, 2.0]) for i in range(9)], f"job_id string, embedding {VECTOR}")
    X.build_index(same, str(tmp_path / "same"), cells=5)
    asked = spark.createDataFrame([(1, [2.0, 4.0]), (2, [-1.0, 0.0])], f"query_id long, embedding {VECTOR}")
    assert rows(X.nearest_indexed(asked, str(tmp_path / "same"))) == {1: ("a0", 1.0)}
    assert X.nearest_indexed(asked.filter("false"), str(tmp_path / "same")).count() == 0
    grown = X.recall(asked, same, str(tmp_path / "same")).first()
    assert (grown.wanted, grown.found, grown.recall) == (1, 1, 1.0)
