import json

import pytest
from pyspark.sql import functions as F

from reporank import fixed, schemas
from reporank.operators import jobs as J
from reporank.operators.metrics import analyze_files, code_metrics
from reporank.operators.normalize import minmax_normalize
from reporank.plans.records import assemble_repos
from reporank.sources import raw, tables
from reporank.streaming.landing import stream_repos


def record(name, **extra):
    ast = {"function_signatures": None, "public_api_count": 3, "test_file_ratio": 0.5,
           "error_handling_density": 0.05, "minhash_fingerprint": [4294967295, 1],
           "total_files": 2, "total_lines": 10, "language": "Go"}
    stats = {"ContributorCount": 4, "CommitRecency": 10, "IssueCloseRate": 0.5}
    return {"full_name": name, "url": "u", "description": "d", "language": "Go", "stars": 1,
            "forks": 0, "ast": ast, "contributor_stats": stats, **extra}


@pytest.fixture
def landed(tmp_path):
    nested = tmp_path / "raw" / "job1" / "owner"
    nested.mkdir(parents=True)
    (nested / "a.json").write_text(json.dumps(record("owner/a")))
    (nested.parent / "flat.json").write_text("\n".join([
        json.dumps(record("o/b")), "{not json", "",
        json.dumps(record("o/c", stars="many")),
        json.dumps({"full_name": "o/d"}),
        json.dumps(record("o/e", contributor_stats={"contributor_count": 7})),
    ]))
    (nested.parent / "_manifest.json").write_text(json.dumps({"job_id": "job1", "count": 5}))
    return str(tmp_path / "raw")


def test_read_repos(spark, landed):
    rows = {r.full_name: r for r in raw.read_repos(spark, landed).collect()}
    assert set(rows) == {"owner/a", "o/b", "o/c", "o/d", "o/e"}
    assert rows["owner/a"].contributor_stats.contributor_count == 4
    assert rows["owner/a"].ast.minhash_fingerprint == [4294967295, 1]
    assert rows["o/c"].stars is None and rows["o/c"].url == "u"
    assert rows["o/d"].contributor_stats is None
    assert rows["o/e"].contributor_stats.contributor_count == 7
    assert [r.line for r in raw.read_rejects(spark, landed).collect()] == ["{not json"]


def test_raw_round_trip_and_manifest(spark, landed, tmp_path):
    repos = raw.read_repos(spark, landed).withColumn("job_id", F.lit("j"))
    out = str(tmp_path / "out")
    raw.write_raw(repos, out)
    raw.write_raw(repos.withColumn("job_id", F.lit("k")).limit(2), out)
    raw.write_raw(repos.limit(3), out)
    again = spark.read.json(out)
    assert {r.job_id: r["count"] for r in raw.manifest(again).collect()} == {"j": 3, "k": 2}
    assert raw.read_repos(spark, f"{out}/job_id=k").count() == 2
    by_job = raw.read_job_repos(spark, out).groupBy("job_id").count()
    assert {r.job_id: r["count"] for r in by_job.collect()} == {"j": 3, "k": 2}
    assert {r.job_id for r in raw.read_job_repos(spark, landed).collect()} == {"job1"}


TREE = {
    "one/__init__.py": "def visible(x):\n    pass\n",
    "one/.hidden/util.py": "def _private():\n    except ValueError:",
    "one/a.go": "func Public(a int) {\r\nif err != nil {\r\n}\r\n",
    "one/a/z.go": "func early()\n",
    "one/a/empty.py": "",
    "one/tests/x.spec.ts": "export function go(\n} catch (e) {\n",
    "one/README.md": "def not_code():",
    "two/_x.JAVA": "public int size(",
    "three/notes.txt": "plain",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    return str(tmp_path / "tree")


def test_source_tree_has_every_file(spark, tree):
    got = {(r.repo, r.path): r.content for r in raw.read_source_files(spark, tree).collect()}
    assert got == {tuple(k.split("/", 1)): v for k, v in TREE.items()}
    only = raw.read_source_files(spark, tree, fixed.LANGUAGES).filter("content IS NOT NULL")
    assert only.count() == 7


def test_code_metrics_of_a_tree(spark, tree):
    files = raw.read_source_files(spark, tree, fixed.LANGUAGES)
    by_file = {r.repo: r.ast for r in analyze_files(files).collect()}
    by_line = {r.repo: r.ast for r in code_metrics(raw.source_lines(files)).collect()}
    assert by_file == by_line
    one = by_file["one"]
    assert one.function_signatures == ["_private", "visible", "early", "Public", "go"]
    assert one.public_api_count == 3
    assert one.total_files == 6 and one.total_lines == 10
    assert one.test_file_ratio == pytest.approx(1 / 6)
    assert one.error_handling_density == pytest.approx(3 / 10)
    assert one.language == "Python"
    assert by_file["two"].language == "Java" and by_file["two"].total_lines == 1
    three = by_file["three"]
    assert three.total_files == 0 and three.language == "" and three.test_file_ratio == 0.0
    assert three.function_signatures is None
    assert three.minhash_fingerprint == [fixed.EMPTY_MINIMUM] * 128


def test_signature_cap_and_public_count(spark):
    rows = [("r", f"f{i % 3}.py", i, f"def f{i}(x):") for i in range(200)]
    df = spark.createDataFrame(rows, "repo string, path string, line_no int, line string")
    ast = code_metrics(df).first().ast
    assert len(ast.function_signatures) == 50 and ast.public_api_count == 200
    assert ast.function_signatures == [f"f{i}" for i in range(0, 150, 3)]


def test_normalize_edge_values(spark):
    rows = [("a", "1", 5.0, None), ("b", "x", 5.0, 2.0), ("c", "3", 5.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, s string, same double, missing double")
    features = {c: F.col(c) for c in ("s", "same", "missing")}
    got = {r.k: r.normalized.asDict() for r in minmax_normalize(df, features=features).collect()}
    assert [got[k]["s_norm"] for k in "abc"] == [0.0, None, 1.0]
    assert [got[k]["same_norm"] for k in "abc"] == [0.0, 0.0, 0.0]
    assert [got[k]["missing_norm"] for k in "abc"] == [0.0, 0.5, 1.0]


def test_assemble_skips_what_could_not_be_fetched(spark):
    items = spark.createDataFrame(
        [("a", "u", None, None, None, 3, 1, 0, [], None), ("b", "u", None, None, None, 2, 1, 0, [], None)],
        schemas.SEARCH_ITEM)
    metrics = spark.createDataFrame([("a", 1)], "full_name string, ast int")
    stats = spark.createDataFrame([], "full_name string, contributor_stats int")
    rows = assemble_repos(items, metrics, stats).collect()
    assert [(r.full_name, r.stars, r.contributor_stats) for r in rows] == [("a", 3, None)]


def ranked(spark, scores):
    rows = [(f"r{i}", float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "full_name string, composite_score double")
    return df.select(
        "*", F.lit("u").alias("url"), F.lit(None).cast("string").alias("description"),
        F.lit("Go").alias("language"), F.lit(1).alias("stars"), F.lit(0.5).alias("relevance_score"),
        F.lit(0.5).alias("quality_score"), F.lit(0.5).alias("health_score"),
        F.struct(F.lit(0.5).alias("relevance")).alias("score_breakdown"))


def test_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "results")
    best = ranked(spark, range(30))
    tables.write_results(best, path, "job")
    tables.write_results(best, path, "job")
    tables.write_results(best.limit(3), path, "other", n=2)
    stored = tables.read_or_empty(spark, path, schemas.RESULTS)
    assert stored.filter("job_id = 'job'").count() == 20
    assert stored.filter("job_id = 'other'").count() == 2
    shown = J.fetch_results(stored, "job").collect()
    assert [r.repo_full_name for r in shown] == [f"r{i}" for i in range(29, 19, -1)]
    assert shown[0].description == "" and json.loads(shown[0].score_breakdown) == {"relevance": 0.5}


def test_queries_and_statuses(spark, tmp_path):
    queries, events = str(tmp_path / "queries"), str(tmp_path / "events")
    new = spark.createDataFrame([("j1", "a", [1.0]), ("j2", "b", None), ("j1", "again", None)],
                                "job_id string, text string, embedding array<double>")
    tables.save_queries(new, queries, events, "2024-01-01 00:00:00")
    tables.save_queries(new.filter("job_id = 'j2'"), queries, events, "2024-01-02 00:00:00")
    stored = tables.read_or_empty(spark, queries, schemas.QUERIES)
    assert {r.job_id: r.text for r in stored.collect()} == {"j1": "a", "j2": "b"}
    jobs = spark.createDataFrame([("j1", "a")], "job_id string, query string")
    tables.append_status(jobs, "running", events, "2024-01-01 00:00:00", 1)
    tables.append_status(jobs, "done", events, "2024-01-01 00:00:00", 2)
    log = tables.read_or_empty(spark, events, schemas.JOB_EVENTS)
    now = {r.job_id: r.status for r in J.latest_status(log).collect()}
    assert now == {"j1": "done", "j2": "pending"}
    assert J.job_status(log, "nobody").count() == 0
    with pytest.raises(ValueError):
        J.status_events(jobs, "lost", "2024-01-01 00:00:00")


def test_stream_of_landed_records(spark, landed, tmp_path):
    out, results = str(tmp_path / "check"), str(tmp_path / "results")
    assert stream_repos(spark, landed).isStreaming
    for _ in range(2):  # a restart lands nothing twice
        stream = stream_repos(spark, landed).select("full_name", "stars")
        writer = stream.writeStream.option("checkpointLocation", out).trigger(availableNow=True)
        writer.format("parquet").start(results).awaitTermination(120)
    stored = spark.read.parquet(results)
    assert sorted(r.full_name for r in stored.collect()) == sorted(
        r.full_name for r in raw.read_repos(spark, landed).collect()
    )


def test_scratch_folder_must_be_shared(spark):
    from types import SimpleNamespace

    from reporank.session import scratch_root

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="shared folder"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_unreadable_files_count(spark, tmp_path):
    """A dangling link is a file without lines; it is not lost."""
    repo = tmp_path / "tree" / "r"
    repo.mkdir(parents=True)
    (repo / "a.py").write_text("def f():\n")
    (repo / "b.py").symlink_to(repo / "nowhere.py")
    files = raw.read_source_files(spark, str(tmp_path / "tree")).collect()
    assert {r.path: r.content for r in files} == {"a.py": "def f():\n", "b.py": None}
    metrics = analyze_files(raw.read_source_files(spark, str(tmp_path / "tree"))).first()
    assert (metrics.ast.total_files, metrics.ast.total_lines) == (2, 1)
