import numpy as np
import pytest

from reporank.operators import nearest as N
from reporank.plans.search import find_cached_job, search

DIMS = 16


def vectors(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, DIMS))
    return [list(map(float, centres[rng.integers(clusters)] * 2 + rng.normal(size=DIMS) * 0.35))
            for _ in range(n)]


def brute_force(asked, held, threshold):
    out = {}
    for q, a in asked:
        best = None
        for j, b in held:
            a_, b_ = np.array(a), np.array(b)
            size = np.linalg.norm(a_) * np.linalg.norm(b_)
            sim = round(float(a_ @ b_ / size), 12) if size else 0.0
            if sim >= threshold and (best is None or (-sim, j) < best):
                best = (-sim, j)
        if best:
            out[q] = (best[1], -best[0])
    return out


def case(seed, clusters):
    asked = [(i, v) for i, v in enumerate(vectors(seed, 150, clusters))]
    held = [(f"j{i:03}", v) for i, v in enumerate(vectors(seed + 1, 300, clusters))]
    held += [(f"copy{i}", asked[i][1]) for i in range(20)] + [("copy0b", asked[0][1])]
    held += [("zero", [0.0] * DIMS)]
    asked += [(900, [0.0] * DIMS)]
    return asked, held


def frames(spark, asked, held):
    incoming = spark.createDataFrame([*asked, (901, None), (902, [])],
                                     "query_id long, embedding array<double>")
    stored = spark.createDataFrame([*held, ("nil", None)], "job_id string, embedding array<double>")
    return incoming.repartition(3), stored.repartition(5)


@pytest.mark.parametrize("clusters", [4, 200])
@pytest.mark.parametrize("way", ["broadcast", "tiles", "small tiles"])
def test_exact(spark, monkeypatch, clusters, way):
    asked, held = case(clusters, clusters)
    incoming, stored = frames(spark, asked, held)
    room = N.BROADCAST_BYTES if way == "broadcast" else 1
    if way == "small tiles":
        monkeypatch.setattr(N, "STORED_TILE", 7)
        monkeypatch.setattr(N, "INCOMING_TILE", 11)
        monkeypatch.setattr(N, "BLOCK", 3)
    got = N.nearest_stored(incoming, stored, threshold=0.9, broadcast_bytes=room)
    found = {r.query_id: (r.job_id, pytest.approx(r.similarity)) for r in got.collect()}
    assert found == brute_force(asked, held, 0.9)
    assert found[0][0] == "copy0"


def test_nothing_stored_or_asked(spark):
    asked, held = case(1, 4)
    incoming, stored = frames(spark, asked, held)
    for room in (1, N.BROADCAST_BYTES):
        assert N.nearest_stored(incoming, stored.limit(0), broadcast_bytes=room).count() == 0
        assert N.nearest_stored(incoming.limit(0), stored, broadcast_bytes=room).count() == 0


def test_cut_off_is_inclusive(spark):
    incoming = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    stored = spark.createDataFrame([("a", [0.92, (1 - 0.92**2) ** 0.5])],
                                   "job_id string, embedding array<double>")
    for room in (1, N.BROADCAST_BYTES):
        assert N.nearest_stored(incoming, stored, broadcast_bytes=room).count() == 1


def test_single_vector(spark):
    asked, held = case(2, 4)
    _, stored = frames(spark, asked, held)
    row = find_cached_job(stored, asked[0][1]).first()
    assert row.job_id == "copy0" and row.similarity == pytest.approx(1)
    assert find_cached_job(stored, [1.0] + [0.0] * (DIMS - 1), 0.999).count() == 0


def test_search_reuses_only_finished_jobs(spark):
    rows = [("q1", "a text", [1.0, 0.0]), ("q2", "b", [0.0, 1.0]), ("q3", "  ", [1.0, 0.0]),
            ("q4", "no vector", None)]
    incoming = spark.createDataFrame(rows, "query_id string, text string, embedding array<double>")
    stored = spark.createDataFrame([("ok", [1.0, 0.1]), ("bad", [0.0, 1.0])],
                                   "job_id string, embedding array<double>")
    events = spark.createDataFrame(
        [("ok", "running", 1, 0), ("ok", "done", 2, 0), ("bad", "done", 1, 0),
         ("bad", "failed", 1, 1)],
        "job_id string, status string, updated_at int, seq int")
    got = {r.query_id: (r.job_id, r.cached) for r in search(incoming, stored, events).collect()}
    assert set(got) == {"q1", "q2", "q4"}
    assert got["q1"] == ("ok", True)
    assert not got["q2"][1] and not got["q4"][1] and got["q2"][0] != got["q4"][0]
    assert {r.query_id: r.job_id for r in search(incoming, stored, any_status=True).collect()}["q2"] == "bad"


def test_vectors_that_rule_nothing_out_are_copied_for_few_tiles(spark, monkeypatch):
    """Without clusters every cell is probed; incoming vectors go to tiles, not to each cell."""
    asked, held = case(9, 200)
    incoming, stored = frames(spark, asked, held)
    seen, tiled = [], N.tiled_hits
    monkeypatch.setattr(N, "tiled_hits", lambda *args: seen.append((args[1].count(), len(args[2]))) or tiled(*args))
    monkeypatch.setattr(N, "STORED_TILE", 120)
    got = N.nearest_stored(incoming, stored, threshold=0.6, broadcast_bytes=1)
    found = {r.query_id: (r.job_id, pytest.approx(r.similarity)) for r in got.collect()}
    assert found == brute_force(asked, held, 0.6)
    assert seen[0][1] < 8 and seen[0][0] == 151 * seen[0][1]


def test_bins():
    assert N._bins(np.array([N.STORED_TILE, 1, 0, N.STORED_TILE - 1, 3 * N.STORED_TILE, 2])) == [0, 1, 1, 1, 2, 3]
