import random

import pytest

from reporank import fixed
from reporank.functions import minhash as M


def murmur3(data: bytes, seed: int) -> int:
    """Published 32-bit algorithm, one byte string at a time."""
    mask = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    scramble = lambda k: rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rot(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5) + 0xE6546B64
        h &= mask
    if data[whole:]:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    return h ^ (h >> 16)


def expected(texts):
    words = {w for t in texts for w in split(t)}
    return [min((murmur3(w.encode(), s) for w in words), default=fixed.EMPTY_MINIMUM)
            for s in range(fixed.NUM_HASHES)]


def split(text):
    for space in fixed.WHITESPACE:
        text = (text or "").replace(space, " ")
    return [w for w in text.split(" ") if w]


TEXTS = [
    "hello, world", "a", "ab abc abcd abcde", "", None, "  　 ",
    "naïve café 日本語\u0085x", "a\x1fb a", "one  two\tthree\nfour\rfive\vsix\f",
]


def test_known_hashes():
    assert murmur3(b"hello", 0) == 0x248BFA47
    assert murmur3(b"hello, world", 0) == 0x149BBB7F


def test_fingerprints_are_exact(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    got = {r.i: r.fp for r in df.select("i", M.minhash("t").alias("fp")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == expected([text]), text


def test_fingerprints_merge_over_rows_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 7)
    monkeypatch.setattr(M, "HELD_KEYS", 2)
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(5)}", " ".join(rng.choices("abcdefghij", k=rng.randrange(9))))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, t string").repartition(4)
    got = {r.k: r.minhash_fingerprint for r in M.minhash_by(df, "k", "t").collect()}
    for key in {k for k, _ in rows}:
        assert got[key] == expected([t for k, t in rows if k == key])


def test_bands_and_jaccard(spark):
    a = list(range(128))
    b = a[:64] + [x + 1000 for x in a[64:]]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    row = df.select(
        M.band_keys("a").alias("ka"), M.band_keys("b").alias("kb"),
        M.jaccard_estimate("a", "b").alias("j"),
    ).first()
    assert len(row.ka) == 16 and row.ka[:8] == row.kb[:8]
    assert not set(row.ka[8:]) & set(row.kb[8:])
    assert row.j == 0.5


@pytest.mark.parametrize("fp, usable", [
    (None, False), ([], False), ([fixed.EMPTY_MINIMUM] * 128, False), ([1] * 128, True)])
def test_has_tokens(spark, fp, usable):
    df = spark.createDataFrame([(fp,)], "fp array<long>")
    assert df.select(M.has_tokens("fp").alias("x")).first().x is usable


def test_collision_rate_follows_the_band_curve(spark):
    """Texts with token overlap s meet in some band with chance 1 - (1 - s^8)^16."""
    rng = random.Random(2)
    rows, hits = [], 0
    for i in range(200):
        shared = [f"s{i}_{j}" for j in range(160)]
        only = [[f"{side}{i}_{j}" for j in range(20)] for side in "xy"]
        rows += [(i, " ".join(rng.sample(shared + o, 180))) for o in only]
    df = spark.createDataFrame(rows, "i int, t string")
    keys = df.select("i", M.band_keys(M.minhash("t")).alias("k")).collect()
    by = {}
    for r in keys:
        by.setdefault(r.i, []).append(set(r.k))
    hits = sum(bool(a & b) for a, b in by.values()) / len(by)
    s = 160 / 200
    assert hits == pytest.approx(1 - (1 - s**8) ** 16, abs=0.08)
