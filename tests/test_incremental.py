"""Stores that take what is new: code metrics, keyed inserts, sketches; status events as a stream; table functions."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import tables
from reporank.functions.minhash import minhash, minhash_by
from reporank.operators import metrics_store as M
from reporank.operators import stats
from reporank.operators.jobs import latest_status
from reporank.operators.metrics import analyze_files, annotate_lines
from reporank.sources import keyed
from reporank.streaming import status

FILES = "repo string, path string, content string"


def tree(**changes):
    files = {
        ("a", "m.py"): "def f(x):\n    pass\nexcept E:\n", ("a", "t/test_m.py"): "def test_f():\n", ("a", "README.md"): "text",
        ("b", "x.go"): "func Run(a int) {\nif err != nil {\n", ("b", "copy.py"): "def f(x):\n    pass\nexcept E:\n",
        ("c", "only.js"): "const go = (x) => 1\n", ("d", "empty.py"): "", ("d", "gone.py"): None,
    }
    return files


def frame(spark, files):
    return spark.createDataFrame([(*k, v) for k, v in files.items()], FILES)


def same(spark, folder, files):
    got = sorted(map(repr, M.stored_metrics(spark, folder).collect()))
    assert got == sorted(map(repr, analyze_files(frame(spark, files)).collect()))


def versions(spark, folder, name):
    found = spark.read.parquet(f"{folder}/{name}").groupBy("version").count().collect()
    return {r.version: r["count"] for r in found}


def test_adds_edits_renames_and_deletes(spark, tmp_path):
    folder, files = str(tmp_path / "m"), tree()
    assert M.update_metrics(frame(spark, files), folder) == 1
    same(spark, folder, files)
    edited = {("a", "m.py"): "def g(x):\n", ("e", "new.java"): "public int x(\n", ("c", "moved.js"): files["c", "only.js"]}
    away = spark.createDataFrame([("c", "only.js"), ("b", "x.go"), ("never", "there.py")], "repo string, path string")
    files |= edited
    del files["c", "only.js"], files["b", "x.go"]
    M.update_metrics(frame(spark, edited | {("a", "t/test_m.py"): files["a", "t/test_m.py"]}), folder, away)
    same(spark, folder, files)
    # a repository loses its last file, a deleted file comes back
    files[("b", "x.go")] = tree()["b", "x.go"]
    del files["c", "moved.js"]
    M.update_metrics(frame(spark, {("b", "x.go"): files["b", "x.go"]}), folder, spark.createDataFrame([("c", "moved.js")], "repo string, path string"))
    same(spark, folder, files)
    assert {r.repo for r in M.stored_metrics(spark, folder).collect()} == {"a", "b", "d", "e"}
    # analysed: five contents first, then the two new ones (a moved file costs nothing), then none
    assert versions(spark, folder, "summaries") == {1: 5, 2: 2}
    # touched repositories only
    assert versions(spark, folder, "metrics") == {1: 4, 2: 4, 3: 2}
    assert {r.path for r in M.current_files(spark, folder).collect()} == {p for _, p in files}


def test_short_contents_are_stored_as_text(spark, tmp_path):
    """Files shorter than a fingerprint cost their text; the totals are those of all their tokens."""
    long = "".join(f"def f{i}(x):\n" for i in range(200))
    files = tree() | {("a", "long.py"): long, ("f", "long.py"): long + "x", ("f", "short.go"): "a\u2003b", ("g", "blank.js"): " \n"}
    folder = str(tmp_path / "m")
    M.update_metrics(frame(spark, files), folder)
    stored = spark.read.parquet(f"{folder}/summaries").collect()
    assert all((r.text is None) != (r.fp is None) for r in stored)
    assert {r.text for r in stored if r.text is not None} == {c for (_, p), c in files.items() if c is not None and p[-3:] != ".md" and len(c) < 512}
    same(spark, folder, files)
    rows = [(repo, n, line) for (repo, p), c in files.items() if p[-3:] != ".md" for n, line in enumerate((c or "").split("\n"))]
    want = minhash_by(spark.createDataFrame(rows, "repo string, n int, line string"), "repo", "line").collect()
    want = {r.repo: r.minhash_fingerprint for r in want}
    assert {r.repo: r.ast.minhash_fingerprint for r in M.stored_metrics(spark, folder).collect()} == want


def test_stores_without_texts_are_read(spark, tmp_path):
    """Summaries of an earlier store have a fingerprint for every content, and no text."""
    folder, files = str(tmp_path / "m"), tree()
    M.update_metrics(frame(spark, files), folder)
    old = spark.read.parquet(f"{folder}/summaries").drop("version")
    old = old.select("digest", "ext", "lines", "error_lines", "public", "sigs", F.coalesce("fp", minhash("text")).alias("fp"))
    old.write.parquet(f"{tmp_path}/old")
    spark.read.parquet(f"{tmp_path}/old").write.mode("overwrite").parquet(f"{folder}/summaries/version=1")
    files[("a", "new.py")] = "def h(x):\n"
    M.update_metrics(frame(spark, {("a", "new.py"): "def h(x):\n"}), folder)
    same(spark, folder, files)


def test_unchanged_files_touch_nothing(spark, tmp_path):
    folder, files = str(tmp_path / "m"), tree()
    M.update_metrics(frame(spark, files), folder)
    M.update_metrics(frame(spark, files), folder)
    same(spark, folder, files)
    assert versions(spark, folder, "metrics") == {1: 4} and versions(spark, folder, "files") == {1: 8}


def test_interrupted_versions_are_not_read(spark, tmp_path):
    folder, files = str(tmp_path / "m"), tree()
    M.update_metrics(frame(spark, files), folder)
    junk = spark.createDataFrame([("a", "junk.py", ".py", "zz", False)], "repo string, path string, ext string, digest string, gone boolean")
    junk.write.parquet(f"{folder}/files/version=2")
    same(spark, folder, files)
    files[("a", "m.py")] = "def h(x):\n"
    assert M.update_metrics(frame(spark, {("a", "m.py"): "def h(x):\n"}), folder) == 2
    same(spark, folder, files)


# keyed inserts

ROWS = "job_id string, n long"


def test_insert_absent(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", i) for i in range(500)] + [("k3", -1), (None, 1)], ROWS)
    assert keyed.insert_absent(first, folder, "job_id", buckets=8).count() == 500
    again = spark.createDataFrame([("k3", 9), ("new", 2), ("new", 1), ("k499", 0)], ROWS)
    for listed in (keyed.LISTED, 1):  # with and without the filter on keys
        added = keyed.insert_absent(again, folder, "job_id", buckets=8, listed=listed)
        assert [tuple(r) for r in added.collect()] == ([("new", 1)] if listed > 1 else [])
    stored = {r.job_id: r.n for r in keyed.read_keyed(spark, folder, first.schema).collect()}
    assert len(stored) == 501 and stored["k3"] == -1 and stored["new"] == 1
    assert keyed.insert_absent(again.filter("false"), folder, "job_id", buckets=8).count() == 0


def test_only_candidate_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    for part in range(4):
        rows = spark.createDataFrame([(f"k{part}-{i}", i) for i in range(400)], ROWS)
        keyed.insert_absent(rows, folder, "job_id", buckets=16)
    new = keyed._bucketed(spark.createDataFrame([("k2-7", 1), ("fresh", 1)], ROWS), "job_id", 16)
    found = keyed.candidates(new, folder, new.drop(keyed.BUCKET).schema, "job_id")
    everything = keyed.read_keyed(spark, folder, new.drop(keyed.BUCKET).schema).inputFiles()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and "PushedFilters: [In(job_id" in plan.replace("IsNotNull(job_id), ", "")
    assert len(everything) == 4 * 16
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert [r.job_id for r in found.collect()] == ["k2-7"] and len(read) == 1
    import pyarrow.parquet as pq

    buckets = {r[0] for r in new.select(keyed.BUCKET).collect()}
    assert sum(any(f"{keyed.BUCKET}={b}/" in f for b in buckets) for f in everything) <= 8
    # files carry the Bloom filter: their key column is followed by more than its pages
    path = everything[0].removeprefix("file://")
    column = next(c for c in range(2) if pq.ParquetFile(path).metadata.row_group(0).column(c).path_in_schema == "job_id")
    assert pq.ParquetFile(path).metadata.row_group(0).column(column).encodings[0] != "PLAIN_DICTIONARY"


# sketches


def test_sketches_merge_over_crawls(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("r", f"a{i % 3000}", day + datetime.timedelta(days=i % 40)) for i in range(9000)]
    rows += [("small", f"b{i % 7}", day) for i in range(50)] + [("none", None, day)]
    commits = spark.createDataFrame(rows, "repo string, author string, committed_at timestamp")
    one, two = (stats.author_sketches(commits.filter(f"hash(author) % 2 {c} 0 OR author IS NULL")) for c in ("=", "<>"))
    both = one.unionByName(two).unionByName(one)  # a crawl that is added twice counts once
    got = {r.repo: r.contributor_count for r in stats.approximate_contributors(both).collect()}
    assert abs(got["r"] - 3000) <= stats.SKETCH_ERROR * 3000 and got["small"] == 7 and got["none"] == 0
    some = stats.approximate_contributors(both, since=F.lit("2024-01-03").cast("date"), until=F.lit("2024-01-04").cast("date"))
    exact = commits.filter("to_date(committed_at) BETWEEN '2024-01-03' AND '2024-01-04'").select("author").distinct().count()
    assert {r.repo: r.contributor_count for r in some.collect()} == {"r": pytest.approx(exact, rel=stats.SKETCH_ERROR)}


# status events as a stream

EVENTS = "job_id string, status string, updated_at timestamp, seq long"


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, status.PROVIDER)
    yield
    spark.conf.set(conf, before)


def run_status(spark, folder):
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    writer = status.status_changes(arriving).writeStream.outputMode("update").trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/state")
    writer.foreachBatch(lambda rows, n: rows.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out, {r.job_id: r.status for r in latest_status(out).collect()}


def test_late_and_doubled_events_and_a_restart(spark, rocks, tmp_path):
    folder, at = str(tmp_path), datetime.datetime(2024, 5, 1)
    minute = lambda m: at + datetime.timedelta(minutes=m)
    batches = [
        [("a", "pending", minute(0), 0), ("a", "running", minute(1), 1), ("b", "running", minute(5), 1)],
        [("b", "pending", minute(0), 0), ("a", "running", minute(1), 1)],  # late, doubled
        [("a", "done", minute(9), 2), ("b", "failed", minute(5), 2), ("c", "pending", minute(0), 0)],
        [("a", "running", minute(1), 1), ("c", "running", minute(0), 1), ("b", "running", minute(4), 9)],
    ]
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        seen += rows
        if i in (1, 3):  # runs twice: the second one goes on from the checkpoint
            out, current = run_status(spark, folder)
            want = latest_status(spark.createDataFrame(seen, EVENTS))
            assert current == {r.job_id: r.status for r in want.collect()}
    # late and doubled events gave no rows
    assert out.count() == len(out.distinct().collect()) and out.filter("job_id = 'b' AND status = 'pending'").count() == 0


def test_finished_jobs_are_forgotten(spark, rocks, tmp_path):
    folder, at, seen = str(tmp_path), datetime.datetime(2024, 5, 1), []
    before = at - datetime.timedelta(days=1)

    def land(*rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def wait(row):
        end = time.monotonic() + 60
        while row not in seen and time.monotonic() < end:
            time.sleep(0.2)
        assert row in seen

    land(("a", "done", at, 1), ("b", "running", at, 1))
    arriving = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
    writer = status.status_changes(arriving, keep_ms=1).writeStream.outputMode("update").trigger(processingTime="200 milliseconds")
    writer = writer.option("checkpointLocation", f"{folder}/state")
    query = writer.foreachBatch(lambda rows, n: seen.extend((r.job_id, r.status) for r in rows.collect())).start()
    try:
        wait(("a", "done"))
        time.sleep(3)  # the timer of a is over when the next batches run
        land(("a", "running", before, 0), ("b", "pending", before, 0))
        wait(("a", "running"))  # a had been forgotten, b had not
        assert ("b", "running") in seen and ("b", "pending") not in seen
    finally:
        query.stop()


# table functions


def test_table_functions(spark):
    tables.register(spark)
    lines = {
        ".py": ["def f(x):", "  def _g (y):", "\u00a0def h(z):", "except ValueError:", "except:", "x = 1", "def ünï(x):", "async def a():"],
        ".go": ["func Run(a int) {", "func run()", "if err != nil {", "func (r *T) x()"],
        ".js": ["function f (", "const g = async (x) =>", "} catch (e) {", "const h = x => 1"],
        ".ts": ["export function k<T>(", "catch(e)"], ".java": ["public int x(", "protected void _y (", "private int z("], ".md": ["def f(x):"],
    }
    rows = [("r", f"p{e}", "\n".join(own) + end, e) for e, own in lines.items() for end in ("", "\n")]
    rows += [("r", "none.py", None, ".py"), ("r", "empty.py", "", ".py"), ("r", "blank.py", "\n\n", ".py")]
    files = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "repo string, path string, content string, ext string, i int")
    got = spark.sql("SELECT f.i, s.* FROM {files} f, LATERAL code_signatures(f.content, f.ext) s", files=files)
    each = spark.createDataFrame(
        [(str(i), f"p{e}", n, x) for i, (_, _, text, e) in enumerate(rows) if text
         for n, x in enumerate((text[:-1] if text.endswith("\n") else text).split("\n"))], "repo string, path string, line_no int, line string",
    )
    want = annotate_lines(each).select(F.col("repo").cast("int").alias("i"), "line_no", "sig", "is_public", "is_error")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "ArrowEvalPythonUDTF" in got._jdf.queryExecution().executedPlan().toString()


def test_reducer_keeps_the_first_of_each_partition(spark):
    tables.register(spark)
    rows = [(f"r{i % 3}", i, f"s{i}" if i % 5 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "repo string, line_no int, sig string").repartition(7)
    got = spark.sql("SELECT * FROM first_signatures(TABLE({t}) PARTITION BY repo ORDER BY line_no)", t=table).collect()
    for repo in ("r0", "r1", "r2"):
        own = [s for r, _, s in sorted(rows, key=lambda x: x[1]) if r == repo and s]
        assert [(x.n, x.sig) for x in sorted(got) if x.repo == repo] == list(enumerate(own[: fixed.SIGNATURE_CAP], 1))
