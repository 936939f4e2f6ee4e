"""Word search over the stored index finds what a whole-word scan finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reporank.operators import word_index as W
from reporank.plans.ranking import search_candidates

SCHEMA = "full_name string, description string, stars long, other int"
QUERIES = ["graph engine", "Fast graph!", "engine", "absent", "the a of", "tiny", "graph engine fast tiny rust", ""]


def repos(n=400):
    rng = random.Random(1)
    words = ["graph", "engine", "fast", "tiny", "rust", "graphs", "x1", "Ünï", "data-base"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
        rows.append((f"owner{i % 7}/repo-{i:03}", text if i % 11 else None, rng.choice([None, *range(40)]), i))
    return rows


def scan(rows, query_words, n):
    def own(r):
        return set(re.findall("[a-z0-9]+", f"{r[0]} {r[1] or ''}".lower()))

    hits = [r for r in rows if query_words and set(query_words) <= own(r)]
    return sorted(hits, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[:n]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("words") / "index")
    table = spark.createDataFrame(repos(), SCHEMA)
    W.build_word_index(table.filter("other < 250"), folder, buckets=16)
    W.append_words(table.filter("other >= 250"), folder)
    return table, folder


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("n", [3, 40])
def test_same_rows_as_a_scan(spark, stored, query, n):
    table, folder = stored
    asked = spark.range(1).select(W.keywords(F.lit(query))).first()[0]
    got = [tuple(r) for r in W.search_words(table, folder, query, n).collect()]
    assert got == scan(repos(), asked, n)


def test_substrings_stay_the_default(spark, stored):
    table, folder = stored
    parts = {r.full_name for r in search_candidates(table, "graph", 400).collect()}
    words = {r.full_name for r in W.search_words(table, folder, "graph", 400).collect()}
    assert words < parts  # graphs holds graph, as a part


def test_only_asked_buckets_and_first_tiers_are_read(spark, stored):
    table, folder = stored
    plan = W.matching(spark, folder, ["graph", "engine"], 0)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan, re.S)
    assert "bucket" in filters[1] and "tier" in filters[1] and "word" in filters[2]
    seen, original = [], W.matching
    W.matching = lambda spark, folder, asked, tier: seen.append(tier) or original(spark, folder, asked, tier)
    try:
        W.search_words(table, folder, "graph", 1).collect()
        early = list(seen)
        seen.clear()
        W.search_words(table, folder, "absent", 1).collect()
    finally:
        W.matching = original
    assert len(early) < len(seen) == 4


def test_frequent_words_have_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_ROWS", 20)
    folder = str(tmp_path / "index")
    W.build_word_index(spark.createDataFrame(repos(), SCHEMA), folder, buckets=2)
    files = W.postings(spark, folder).filter("bucket = 0 AND tier = 3").inputFiles()
    assert len(files) > 1
    assert W.search_words(spark.createDataFrame(repos(), SCHEMA), folder, "graph", 500).count() == len(scan(repos(), ["graph"], 500))


def test_nothing_indexed(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    W.build_word_index(empty, str(tmp_path / "index"))
    assert W.search_words(empty, str(tmp_path / "index"), "graph engine").count() == 0
