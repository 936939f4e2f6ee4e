"""Batches into the stored dedup index give the rows of one whole batch."""

import itertools
import random

import pytest

from reporank import fixed
from reporank.operators import dedup_store as S
from reporank.operators.dedup import dedup

SCHEMA = "full_name string, minhash_fingerprint array<long>, stars long"


def repos(seed=1, n=60):
    """Chains of fingerprints that share single bands, exact copies, empty ones, equal stars."""
    rng = random.Random(seed)
    fresh = lambda: [rng.randrange(1, 2**32 - 1) for _ in range(fixed.NUM_HASHES)]
    prints = [fresh() for _ in range(12)]
    for _ in range(n - 12):
        own, other = fresh(), rng.choice(prints)
        for band in rng.sample(range(fixed.NUM_BANDS), rng.choice([0, 1, 1, 2, 16])):
            part = slice(band * fixed.BAND_ROWS, (band + 1) * fixed.BAND_ROWS)
            own[part] = other[part]
        prints.append(own)
    rows = [(f"r{i:03}", p, rng.randrange(6)) for i, p in enumerate(prints)]
    rows += [("empty1", [fixed.EMPTY_MINIMUM] * fixed.NUM_HASHES, 9), ("empty2", [], 9), ("empty3", None, None)]
    return rows


def flags(df, key="full_name"):
    return {r[key]: r.is_duplicate for r in df.collect()}


def add_all(spark, parts, folder):
    for i, part in enumerate(parts):
        S.add_batch(spark.createDataFrame(part, SCHEMA), folder, f"b{i}")


def whole(spark, rows, rule):
    return flags(dedup(spark.createDataFrame(rows, SCHEMA), rule))


@pytest.mark.parametrize("seed", [1, 2])
def test_halves_in_any_order(spark, tmp_path, seed):
    rows = repos(seed)
    want = {rule: whole(spark, rows, rule) for rule in ("cluster", "any_band")}
    assert sum(want["cluster"].values()) > 10
    for order in itertools.permutations((rows[::2], rows[1::2])):
        folder = str(tmp_path / f"order-{order[0][0][0]}")
        add_all(spark, order, folder)
        for rule, flags_ in want.items():
            assert flags(S.stored_flags(spark, folder, rule), "id") == flags_


def test_many_small_batches_merge_components(spark, tmp_path):
    """Bridges come last: they join components that earlier batches had named."""
    rows = repos(5, 40)
    order = list(reversed(rows))
    add_all(spark, [order[i : i + 8] for i in range(0, len(order), 8)], str(tmp_path / "d"))
    for rule in ("cluster", "any_band"):
        assert flags(S.stored_flags(spark, str(tmp_path / "d"), rule), "id") == whole(spark, rows, rule)
    renamed = S._read(spark, str(tmp_path / "d"), "renamed", S._batches(spark, str(tmp_path / "d"))[-1:])
    assert renamed.count() > 0  # or the test shows nothing
    assert renamed.groupBy("component").count().filter("count > 1").count() == 0


def test_history_is_not_hashed_again(spark, tmp_path):
    """A later batch reads stored ids, prints and bucket owners, never the first batch's table."""
    rows, folder = repos(3), str(tmp_path / "d")
    first = str(tmp_path / "first")
    spark.createDataFrame(rows[:40], SCHEMA).write.parquet(first)
    S.add_batch(spark.read.parquet(first), folder, "one")
    import shutil

    shutil.rmtree(first)
    S.add_batch(spark.createDataFrame(rows[40:], SCHEMA), folder, "two")
    assert flags(S.stored_flags(spark, folder), "id") == whole(spark, rows, "cluster")


def test_finished_and_interrupted_batches(spark, tmp_path):
    rows, folder = repos(4), str(tmp_path / "d")
    add_all(spark, [rows[:30], rows[30:]], folder)
    want = flags(S.stored_flags(spark, folder), "id")
    S.add_batch(spark.createDataFrame(rows[:3], SCHEMA), folder, "b1")  # finished: nothing happens
    assert flags(S.stored_flags(spark, folder), "id") == want
    # what an interrupted run left is not read, and goes when the batch is added again
    junk = spark.createDataFrame([("junk", 0, "p")], "id string, low long, print string")
    junk.write.parquet(f"{folder}/repos/b2")
    assert flags(S.stored_flags(spark, folder), "id") == want
    more = [("r000", rows[20][1], 99), ("new", rows[20][1], 99)]  # r000 is stored already: left as it is
    S.add_batch(spark.createDataFrame(more, SCHEMA), folder, "b2")
    got = flags(S.stored_flags(spark, folder), "id")
    assert got.keys() == want.keys() | {"new"} and not got["new"]
    assert got == whole(spark, [*rows, more[1]], "cluster")


def test_nothing_stored(spark, tmp_path):
    folder = str(tmp_path / "d")
    assert S.stored_flags(spark, folder).count() == 0
    S.add_batch(spark.createDataFrame([], SCHEMA), folder, "empty")
    assert S.stored_flags(spark, folder, "any_band").count() == 0
    with pytest.raises(ValueError):
        S.stored_flags(spark, folder, "other")
