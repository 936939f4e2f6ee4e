"""Trees as a data source with balanced splits, and a folder of landing files as a stream."""

import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from reporank.operators.metrics import analyze_files
from reporank.sources import tree as T
from reporank.sources.raw import read_source_files


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Three small repositories and a large one, hidden names, odd bytes, a dangling link."""
    top = tmp_path_factory.mktemp("trees")
    files = {
        "one/a.py": "def f(x):\n    pass\n", "one/pkg/__init__.py": "", "one/pkg/_b.PY": "x = 1", "one/.hidden/c.go": "func A() {}\n",
        "one/README.md": "# one", "two/deep/er/and/deeper/d.js": "const f = (x) => 1\n", "three/empty/.keep": "", "stray.py": "no repository",
        "größe/ü ñ.py": "def g(x):\n",
    }
    files |= {f"large/d{i % 17}/f{i}.py": f"def f{i}(x):\n" * (1 + i % 50) for i in range(300)}
    for name, text in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (top / "two/odd.py").write_bytes(b"def \xff\xfe(x):\n")
    os.symlink(top / "nowhere", top / "two/gone.py")
    os.symlink(top / "one", top / "two/linked")  # not followed
    return str(top)


def rows(df):
    return {(r.repo, r.path): r.content for r in df.collect()}


def test_same_files_as_the_plain_reader(spark, root):
    want = {k: v for k, v in rows(read_source_files(spark, root)).items()}
    got = rows(T.read_tree(spark, root))
    assert got == want and got["two", "gone.py"] is None and ("one", "pkg/__init__.py") in got
    assert len(got) == 300 + 8 + 2 and not any(repo == "stray.py" for repo, _ in got)


def test_suffixes_go_into_the_listing(spark, root):
    listing = T.list_tree(spark, root, (".PY",))
    names = {(r.repo, r.path): r.bytes for r in listing.collect()}
    assert all(p.lower().endswith(".py") for _, p in names) and ("one", "pkg/_b.PY") in names
    assert names["one", "pkg/_b.PY"] == 5 and names["two", "gone.py"] == 0
    assert rows(T.read_tree(spark, root, (".py",))).keys() == names.keys()


def test_splits_are_balanced_and_cut_large_repositories(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_COST", 0)
    total = sum(r.bytes for r in T.list_tree(spark, root).collect())
    T.write_splits(T.list_tree(spark, root), str(tmp_path / "l"), total // 10)
    reader = T.TreeReader({"path": root, "listing": str(tmp_path / "l")})
    splits = reader.partitions()
    sizes = [sum(b.column("bytes").to_pylist()) for b in ([x for x in s] for s in map(lambda p: list(reader.read(p)), splits)) for b in b]
    assert len(splits) in (10, 11) and max(sizes) < 2.5 * total / 10
    held = [{r for b in reader.read(p) for r in b.column("repo").to_pylist()} for p in splits]
    assert sum("large" in h for h in held) == len(splits)


def test_no_folder_is_listed_twice_and_levels_are_shared(spark, root, monkeypatch):
    """Every level is dealt out over all tasks by folder, not by repository."""
    plans = []
    original = T.written
    monkeypatch.setattr(T, "written", lambda df: plans.append(df) or original(df))
    T.list_tree(spark, root)
    assert len(plans) == 6  # levels of folders: root, repositories, and four below two/deep
    assert all("Exchange hashpartitioning(xxhash64(name" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_filters_are_applied_before_files_are_opened(spark, root, tmp_path):
    T.write_splits(T.list_tree(spark, root), str(tmp_path / "l"))
    reader = T.FilteringTreeReader({"path": root, "listing": str(tmp_path / "l")})
    left = list(reader.pushFilters([T.EqualTo(("repo",), "one"), T.StringEndsWith(("path",), ".go"), T.EqualTo(("content",), "x")]))
    assert [f.attribute for f in left] == [("content",)]
    opened, original = [], T._content
    T._content = lambda system, name: opened.append(name) or original(system, name)
    try:
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        T._content = original
    assert [(r["repo"], r["path"]) for r in got] == [("one", ".hidden/c.go")] and len(opened) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        files = T.read_tree(spark, root).filter("repo IN ('one', 'two') AND startswith(path, 'pkg/')")
        assert rows(files).keys() == {("one", "pkg/__init__.py"), ("one", "pkg/_b.PY")}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_split_can_be_read_again(spark, root, tmp_path):
    """What a lost task had read comes again from its listing, also if it stopped half way."""
    T.write_splits(T.list_tree(spark, root), str(tmp_path / "l"), 1 << 14)
    reader = T.TreeReader({"path": root, "listing": str(tmp_path / "l")})
    split = reader.partitions()[0]
    next(iter(reader.read(split)))  # abandoned
    first, second = ([r for b in reader.read(split) for r in b.to_pylist()] for _ in range(2))
    assert first == second and first
    # a task that fails once is tried again by Spark and gives the same rows
    files = T.read_tree(spark, root, (".py",), split_bytes=1 << 16)
    assert files.count() == files.count()


def test_metrics_over_the_source(spark, root):
    plain = analyze_files(read_source_files(spark, root, (".py", ".go", ".js")).filter("content IS NOT NULL"))
    source = analyze_files(T.read_tree(spark, root, (".py", ".go", ".js")).filter("content IS NOT NULL").select("repo", "path", "content"))
    assert sorted(map(repr, source.collect())) == sorted(map(repr, plain.collect()))


def test_empty_roots(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert T.read_tree(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        T.TreeReader({"path": str(tmp_path)})


def land(folder, name, text, age=10.0):
    path = pathlib.Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    at = time.time() - age
    os.utime(path, (at, at))


def test_landing_stream(spark, tmp_path):
    """Batches hold what is new, a restart goes on where the checkpoint is, young files wait."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = T.stream_landed(spark, folder, settle="1").select("path", "content")
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.content for r in spark.read.schema("path string, content string").parquet(out).collect())

    land(folder, "a/r1.json", "one", 60)
    land(folder, "b/r2.json", "two", 50)
    land(folder, "b/r2.txt", "not a record", 50)
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    land(folder, "a/r3.json", "three", 40)
    land(folder, "a/same.json", "four", 40)
    land(folder, "young.json", "five", -30)  # still being written, by its clock
    assert run() == ["four", "one", "three", "two"]
    land(folder, "young.json", "five", 5)
    assert run() == ["five", "four", "one", "three", "two"]


def test_landing_splits(tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    for i in range(20):
        land(folder, f"r{i:02}.json", "x" * 1000, 100 - i)
    reader = T.LandedReader({"path": folder})
    start, end = reader.initialOffset(), reader.latestOffset()
    monkeypatch.setattr(T, "SPLIT_BYTES", 5000)
    monkeypatch.setattr(T, "FILE_COST", 0)
    parts = reader.partitions(start, end)
    assert [len(p.files) for p in parts] == [5, 5, 5, 5]
    assert len([r for p in parts for r in reader.read(p)]) == 20
    assert reader.partitions(end, end) == [] and reader.latestOffset() == end
    middle = {"modified": parts[1].files[-1][2], "name": parts[1].files[-1][0]}
    assert sum(len(p.files) for p in reader.partitions(middle, end)) == 10
