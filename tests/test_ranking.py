"""Rankings against the formulas worked out in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reporank import fixed, schemas
from reporank.plans import ranking as R
from reporank.plans.results import present, result_count
from reporank.sources.tables import result_rows


def fingerprint(rng):
    return [rng.randrange(1 << 32) for _ in range(fixed.NUM_HASHES)]


def make_repos(seed=1, n=40):
    rng = random.Random(seed)
    prints = [fingerprint(rng) for _ in range(n - 8)]
    maybe = lambda x, p=0.15: None if rng.random() < p else x
    out = []
    for i in range(n):
        ast = {
            "function_signatures": maybe([f"f{j}" for j in range(rng.randrange(14))]),
            "public_api_count": maybe(rng.randrange(100)),
            "test_file_ratio": maybe(rng.randrange(32) / 32),
            "error_handling_density": maybe(rng.random() / 5),
            "minhash_fingerprint": prints[i % len(prints)],
            "total_files": 3, "total_lines": rng.randrange(1000), "language": "Go",
        }
        stats = {"contributor_count": maybe(rng.randrange(80)),
                 "commit_recency": maybe(rng.randrange(-2, 500)),
                 "issue_close_rate": maybe(rng.random())}
        out.append({
            "full_name": f"o/r{i:02}", "url": f"u{i}", "description": maybe(f"text {i}"),
            "language": None, "stars": maybe(rng.randrange(9)), "forks": 1, "ast": ast,
            "contributor_stats": maybe(stats),
            "embedding": maybe([rng.gauss(0, 1) for _ in range(6)]),
        })
    return out


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def expected(repos, query):
    best = {}
    for r in repos:
        key = tuple(r["ast"]["minhash_fingerprint"])
        rank = (-(r["stars"] or 0), r["full_name"])
        best[key] = min(best.get(key, rank), rank)
    kept = [r for r in repos if best[tuple(r["ast"]["minhash_fingerprint"])][1] == r["full_name"]]
    apis = [float(r["ast"]["public_api_count"] or 0) for r in kept]
    lo, hi = min(apis), max(apis)
    out = []
    for r, api in zip(kept, apis):
        a, c = r["ast"], r["contributor_stats"] or {}
        rel = round(cosine(query, r["embedding"]), 4)
        norm = round((api - lo) / ((hi - lo) or 1.0), 4)
        qual = round(0.40 * (a["test_file_ratio"] or 0)
                     + 0.35 * min((a["error_handling_density"] or 0) / 0.10, 1.0) + 0.25 * norm, 4)
        days = c.get("commit_recency")
        days = 365 if days is None else days
        rec = 1.0 if days <= 0 else max(0.0, 1.0 - days / 365)
        people = min(math.log1p(c.get("contributor_count") or 0) / math.log1p(50), 1.0)
        heal = round(0.40 * rec + 0.35 * people + 0.25 * (c.get("issue_close_rate") or 0), 4)
        comp = round(0.50 * rel + 0.30 * qual + 0.20 * heal, 4)
        out.append((r["full_name"], rel, qual, heal, comp))
    return sorted(out, key=lambda x: (-x[4], x[0]))


def frame(spark, repos, schema):
    return spark.createDataFrame([tuple(r.values()) for r in repos], schema)


@pytest.fixture(scope="module")
def repo_schema():
    from pyspark.sql import types as T

    return T.StructType([*schemas.REPO.fields, T.StructField("embedding", schemas.VECTOR)])


COLUMNS = ["full_name", "relevance_score", "quality_score", "health_score", "composite_score"]


@pytest.mark.parametrize("rule", ["cluster", "any_band"])
def test_full_ranking(spark, repo_schema, rule):
    repos, query = make_repos(), [1.0, 0.5, 0.0, -1.0, 0.2, 0.0]
    got = R.rank_repos(frame(spark, repos, repo_schema), query, 20, rule).select(*COLUMNS)
    assert [tuple(r) for r in got.collect()] == expected(repos, query)[:20]


def test_many_jobs_in_one_plan(spark, repo_schema):
    queries = {"a": [1.0, 0, 0, 0, 0, 0], "b": [0, 1.0, 0, 0, 0, 0.5], "c": None}
    batches = {job: make_repos(seed) for seed, job in enumerate(queries)}
    repos = None
    for job, rows in batches.items():
        part = frame(spark, rows, repo_schema).withColumn("job_id", F.lit(job))
        repos = part if repos is None else repos.unionByName(part)
    asked = spark.createDataFrame(
        [(j, [float(x) for x in v]) for j, v in queries.items() if v],
        "job_id string, embedding array<double>")
    ranked = R.rank_jobs(repos, asked, 7)
    for job, rows in batches.items():
        got = ranked.filter(F.col("job_id") == job).orderBy(F.desc("composite_score"), "full_name")
        want = expected(rows, queries[job])[:7]
        assert [tuple(r) for r in got.select(*COLUMNS).collect()] == want
    counts = result_count(result_rows(ranked)).collect()
    assert {r.job_id: r["count"] for r in counts} == {"a": 7, "b": 7, "c": 7}


def test_ranking_without_vectors_embeds_the_survivors(spark, repo_schema):
    repos = make_repos(3)
    texts = frame(spark, repos, repo_schema).drop("embedding")
    row = R.with_embedding(texts.filter("full_name = 'o/r20'")).select("embedding").first()
    best = R.rank_repos(texts, row.embedding, 40, "any_band")
    assert best.filter("full_name = 'o/r20'").first().relevance_score == 1.0
    assert best.filter("composite_score IS NULL").count() == 0


def test_lite_ranking_keeps_the_most_starred(spark):
    rows = [(f"r{i}", "u", "c", "a test kit" if i % 2 else None, "Go", i * 400, i * 10, i % 3,
             ["x"], None) for i in range(15)]
    items = spark.createDataFrame(rows, schemas.SEARCH_ITEM).withColumn(
        "updated_at", F.lit("2024-01-01").cast("timestamp"))
    as_of = F.lit("2024-01-02").cast("timestamp")
    got = R.rank_lite(items, as_of).collect()
    assert {r.full_name for r in got} == {f"r{i}" for i in range(5, 15)}
    scores = [r.composite_score for r in got]
    assert scores == sorted(scores, reverse=True)
    by_name = {r.full_name: r for r in got}
    odd = by_name["r13"]
    qual = round(0.3 + 0.4 * min(5200 / 5000, 1) + 0.3 * 0.13, 4)
    heal = round(0.6 * (1 - 1 / 365) + 0.4 * 0.5, 4)
    assert (odd.relevance_score, odd.quality_score, odd.health_score) == (0.5, qual, heal)
    assert odd.composite_score == pytest.approx(0.25 + 0.3 * qual + 0.2 * heal)
    assert odd.score_breakdown.stars == 5200
    vectors = items.withColumn("embedding", F.when(F.col("full_name") != "r14", F.array(F.lit(1.0))))
    with_query = {r.full_name: r.relevance_score for r in R.rank_lite(vectors, as_of).collect()}
    assert with_query["r14"] == 0.5 and with_query["r13"] == 0.0


def test_candidates(spark):
    rows = [("o/vector-db", "Fast SEARCH engine", 5), ("o/x", "vector search", 9), ("o/y", None, 50)]
    repos = spark.createDataFrame(rows, "full_name string, description string, stars int")
    names = lambda q, n=40: [r.full_name for r in R.search_candidates(repos, q, n).collect()]
    assert names("a good vector search library") == ["o/x", "o/vector-db"]
    assert names("vector search", 1) == ["o/x"]
    assert names("the best library") == []


def test_page_rows(spark, repo_schema):
    ranked = R.rank_repos(frame(spark, make_repos(), repo_schema), [1.0, 0, 0, 0, 0, 0], 20)
    page = present(ranked.withColumn("repo_full_name", F.col("full_name"))).collect()
    assert [r["rank"] for r in page] == list(range(1, 11))
    assert {r.language_badge for r in page} == {"Unknown"}
    assert all(r.composite.endswith("%") for r in page)


@pytest.mark.parametrize("rule", ["cluster", "any_band"])
@pytest.mark.parametrize("cut", [1 << 14, 7])
def test_jobs_of_a_pool_share_their_candidates(spark, repo_schema, monkeypatch, rule, cut):
    monkeypatch.setattr("reporank.operators.pools.near_best.__defaults__", (cut, 2))
    pools = {p: frame(spark, make_repos(p), repo_schema).withColumn("pool", F.lit(p)) for p in (1, 2)}
    shared = pools[1].unionByName(pools[2]).withColumn("job_id", F.lit("x"))
    if cut == 7:  # names that repeat, and some that are missing
        again = pools[2].filter("full_name < 'o/r15'").withColumn("stars", F.col("stars") + 3)
        lost = pools[2].filter("full_name > 'o/r25'").withColumn("full_name", F.lit(None).cast("string"))
        shared = shared.unionByName(again.unionByName(lost).withColumn("job_id", F.lit("x")))
    vectors = [[1.0, 0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0, 0.5], None, [0.0] * 6, [0.2, 0, -1.0, 0, 0, 0]]
    jobs = [(f"{p}-{n}", [float(x) for x in v] if v else None, p) for p in (1, 2) for n, v in enumerate(vectors)]
    asked = spark.createDataFrame([*jobs, ("none", [1.0] * 6, None)], "job_id string, embedding array<double>, pool int")
    copied = shared.drop("job_id").join(asked.select("job_id", "pool"), "pool").drop("pool")
    columns = ["job_id", *COLUMNS, "score_breakdown", "normalized"]
    want = R.rank_jobs(copied, asked.select("job_id", "embedding"), 7, rule).select(*columns)
    got = R.rank_pools(shared, asked, "pool", 7, rule).select(*columns)
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) != []


def test_candidates_are_few_and_hold_the_best(monkeypatch):
    """Rows are compared in steps; what is passed on has the best of every job and little else."""
    import numpy as np

    from reporank.operators import pools

    monkeypatch.setattr(pools, "STEP", 50)
    rng = np.random.default_rng(1)
    asked, rows = rng.normal(size=(30, 8)).astype(np.float32), rng.normal(size=(1000, 8)).astype(np.float32)
    x, y = pools._candidates(asked, rows, 10, np.float32(1e-3))
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :10]
    assert {(i, j) for i in range(30) for j in best[i]} <= set(zip(x.tolist(), y.tolist())) and len(x) < 330
    x, y = pools._candidates(asked, np.ones((120, 8), np.float32), 10, np.float32(1e-3))
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x) == 30 * 120  # all tie
    assert len(pools._candidates(asked, rows[:4], 10, np.float32(1e-3))[0]) == 120
