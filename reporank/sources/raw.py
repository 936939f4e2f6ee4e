"""Reading landed repository records and source trees; writing raw records."""

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reporank import schemas

CORRUPT = "_corrupt_record"
READ_BYTES = 8 << 20  # file content per Arrow batch


def _raw_schema():
    fields = [
        T.StructField("contributor_stats", schemas.RAW_CONTRIBUTOR_STATS)
        if f.name == "contributor_stats"
        else f
        for f in schemas.REPO.fields
    ]
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])


def read_options() -> dict:
    """Find records at any depth below a job folder; Spark skips ``_manifest.json`` itself."""
    return {
        "recursiveFileLookup": "true",
        "pathGlobFilter": "*.json",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def _tidy(raw):
    """Both spellings of the contributor fields become one."""
    stats = F.col("contributor_stats")
    both = [
        ("contributor_count", "ContributorCount"),
        ("commit_recency", "CommitRecency"),
        ("issue_close_rate", "IssueCloseRate"),
    ]
    one = F.struct(*[F.coalesce(stats[a], stats[b]).alias(a) for a, b in both])
    return raw.withColumn("contributor_stats", F.when(stats.isNotNull(), one)).drop(CORRUPT)


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repository records, one JSON object per line, with a declared schema.

    A line that is no JSON object is skipped. A field of the wrong type becomes
    null; the rest of its record stays.
    """
    raw = spark.read.schema(_raw_schema()).options(**read_options()).json(path)
    return _tidy(raw.filter(F.col(CORRUPT).isNull() | F.col("full_name").isNotNull()))


def read_job_repos(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_repos`, with the job folder each record lies in as ``job_id``."""
    raw = spark.read.schema(_raw_schema()).options(**read_options()).json(path)
    root = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"/{root}/(?:job_id=)?([^/]+)/", 1)
    whole = F.col(CORRUPT).isNull() | F.col("full_name").isNotNull()
    return _tidy(raw.withColumn("job_id", F.url_decode(folder)).filter(whole))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines :func:`read_repos` skips."""
    raw = spark.read.schema(_raw_schema()).options(**read_options()).json(path)
    skipped = raw.filter(F.col(CORRUPT).isNotNull() & F.col("full_name").isNull())
    return skipped.select(F.col(CORRUPT).alias("line"))


def write_raw(repos: DataFrame, path: str) -> None:
    """One JSON object per repository below ``path/job_id=<job>``; reruns replace only
    the jobs they contain. Rows of a job are brought together, big jobs in several files."""
    writer = repos.hint("rebalance", "job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("job_id").json(path)


def manifest(repos: DataFrame) -> DataFrame:
    """Records per job."""
    return repos.groupBy("job_id").agg(F.count("*").alias("count"))


def _filesystem(path):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _batches(rows, names, size=4096):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, schema=names)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=names)


def _content(system, name):
    """Text of a file; one that is not there (a dangling link) or closed to us has no lines.

    Any other failure, such as a lost datanode, fails the task, which is then tried again.
    """
    try:
        with system.open_input_file(name) as file:
            return file.read().decode("utf-8", "replace")
    except (FileNotFoundError, PermissionError):
        return None


def _files(system, start):
    """Paths of all files below a folder; dangling links, which only local folders have, too."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        for folder, _, names in os.walk(start):
            yield from (f"{folder}/{name}" for name in names)
    else:
        for info in system.get_file_info(fs.FileSelector(start, recursive=True)):
            if info.type == fs.FileType.File:
                yield info.path


def _list_tree(spark, root):
    """``(repo, path, uri)`` of every file below ``root/<repo>/``; listing runs in tasks."""
    from pyarrow import fs

    repos = pa.schema([("repo", pa.string())])
    files = pa.schema([("repo", pa.string()), ("path", pa.string())])

    def children(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                system, folder = _filesystem(top)
                for info in system.get_file_info(fs.FileSelector(folder)):
                    if info.type == fs.FileType.Directory:
                        yield pa.RecordBatch.from_pylist([{"repo": info.base_name}], repos)

    def walk(batches):
        system, folder = _filesystem(root)
        for batch in batches:
            for repo in batch.column(0).to_pylist():
                start = f"{folder.rstrip('/')}/{repo}"
                rows = ({"repo": repo, "path": p[len(start) + 1 :]} for p in _files(system, start))
                yield from _batches(rows, files)

    top = spark.createDataFrame([(root,)], "root string")
    found = top.mapInArrow(children, "repo string").repartition("repo")
    return found.mapInArrow(walk, "repo string, path string").repartition("repo", "path")


def read_source_files(spark: SparkSession, root: str, suffixes=None) -> DataFrame:
    """``(repo, path, content)`` of every file below ``root/<repo>/``.

    Spark's own file sources skip names that start with ``_`` or ``.``, which
    would lose every ``__init__.py``; so tasks list the folders and read the
    files themselves. ``suffixes`` leaves other files unread, with null content.
    """
    suffixes = tuple(suffixes or ())

    def load(batches):
        system, folder = _filesystem(root)
        for batch in batches:
            part, held = [], 0
            for row in batch.to_pylist():
                content = None
                if not suffixes or row["path"].lower().endswith(suffixes):
                    name = f"{folder.rstrip('/')}/{row['repo']}/{row['path']}"
                    content = _content(system, name)
                part.append({**row, "content": content})
                held += len(content or "")
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(part, schema=schema)
                    part, held = [], 0
            if part:
                yield pa.RecordBatch.from_pylist(part, schema=schema)

    schema = pa.schema([(n, pa.string()) for n in schemas.SOURCE_FILE.names])
    return _list_tree(spark, root).mapInArrow(load, schemas.SOURCE_FILE)


def content_lines(content) -> Column:
    """Lines of a text, null when it has none; a final line break starts no new line."""
    lines = F.split(F.regexp_replace(content, "\n\\z", ""), "\n")
    return F.when(F.length(content) > 0, lines)


def source_lines(files: DataFrame) -> DataFrame:
    """``(repo, path, line_no, line)`` of file rows, in file order.

    A file without lines gives one row with a null line, so that it still counts
    as a file.
    """
    numbered = F.posexplode_outer(content_lines(F.col("content"))).alias("line_no", "line")
    return files.select("repo", "path", numbered)


def read_source_lines(spark: SparkSession, root: str, suffixes=None) -> DataFrame:
    return source_lines(read_source_files(spark, root, suffixes))
