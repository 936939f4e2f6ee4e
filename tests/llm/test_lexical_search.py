"""Ranked search against a plain version, tie rules, bounded tiles."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import lower
from reporank.llm import lexical_search as search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, row int, rank string, score int, terms string, n int, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, "z") for i, t in rows], CLASHING)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 5, "d") for i, t in rows], "item_id long, text string, doc_id int, row string")


def plain(docs, items, k=10):
    """(position of the item, rank, doc_id, score)"""
    own = [(i, Counter(WORD.findall(lower(t)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_all, long = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n_all) // long
            score = 0
            for t in WORD.findall(lower(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((place, rank, i, -score))
    return out


def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Ab", "ab!", "c9", "éa", "ÄÖ", "x_y", "the", f"r{rng.randrange(60)}"]) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(15)]  # more ties than places
    rows += [(None, None), (None, rows[3][1]), (300, ""), (301, "?!"), (7, rows[9][1]), (7, "r1 r2 r2"), (302, "r5 " * 3000)]
    return rows


ITEMS = [(1, "r1 r2 r3 ab"), (1, "r1 r2 r3 ab"), (2, None), (3, ""), (4, "nowhere at all"), (None, "r5 r5 r5 C9"), (5, "ab c9 éa x y"), (6, "Äö ÄÖ r17")]


@pytest.mark.parametrize("item_bytes", [search.ITEM_BYTES, 30])
def test_same_ranks(spark, item_bytes):
    docs, rows = corpus(), [*ITEMS, (9, corpus()[3][1])]
    got = search.ranked(frame(spark, docs).repartition(7), asked(spark, rows), item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(got.dtypes)["rank"] == "int"
    want = sorted(((rows[p][0], *rest) for p, *rest in plain(docs, rows)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_small_tiles_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCS", 16)
    monkeypatch.setattr(search, "PENDING", 20)
    monkeypatch.setattr(search, "BATCH_TERMS", 50)
    monkeypatch.setattr(search.tiles, "__defaults__", (2, 3))
    monkeypatch.setattr(search.pieces, "__defaults__", (16,))
    docs, rows = corpus(), [*ITEMS, (9, corpus()[3][1])]
    got = search.ranked(frame(spark, docs), asked(spark, rows), k=4)
    want = sorted(((rows[p][0], *rest) for p, *rest in plain(docs, rows, 4)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = frame(spark, []), asked(spark, [])
    assert search.ranked(docs, asked(spark, ITEMS)).count() == 0
    assert search.ranked(frame(spark, corpus()), items).count() == 0
    assert search.ranked(docs, items).count() == 0


def test_pieces_hold_all_terms():
    text = " ".join(f"W{i}é" for i in range(500)) + "  " * 40 + "x" * 300
    want = [t.encode() for t in WORD.findall(lower(text))]
    assert [t for p in search.pieces(text, 50) for t in p] == want
    assert max(len(b" ".join(p)) for p in search.pieces(text, 50)) <= 301 + 50


def test_partial_sums_are_bounded():
    """Weights beyond what one product may sum are cut, and nothing of them is lost."""
    vocabulary = search.Vocabulary(list(range(3)), ["a b c a", "b d", "a " * 9])
    weight = np.array([5_000_000_000, 40_000, 9_000_000_000, 7], dtype=np.int64)
    total = np.zeros((3, 4), dtype=np.int64)
    for first, items, parts in search.tiles(vocabulary, weight, 2, 2):
        for terms, item, column, value in parts:
            assert len(terms) <= 2 and len(set(zip(item, column))) == len(item)
            sums = np.bincount(item, value, items)
            assert (sums * search.TOP_IMPACT < 2**53).all()
            np.add.at(total, (item + first, terms[column]), value.astype(np.int64))
    want = np.zeros((3, 4), dtype=np.int64)
    want[vocabulary.item, vocabulary.term] = vocabulary.count * weight[vocabulary.term]
    assert (total == want).all()


def test_no_impact_reaches_the_bound():
    tf, n = np.array([1, 10**6, 10**9]), np.array([1, 10**6, 10**9])
    assert (search.impacts(tf, n, 10, 10**10) < search.TOP_IMPACT).all()
