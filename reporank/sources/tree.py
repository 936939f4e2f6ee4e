"""Source trees and landing folders as Spark data sources.

``source_tree`` reads the files of repository trees, ``root/<repo>/<path>``. A Spark job lists
the tree level by level: the folders of one level are dealt out to all tasks, so neither a
large root nor a large repository is listed in one place. The listing keeps only files with
the wanted suffixes and is written in as many files as it has splits; a file goes to a split
by its hash, so splits have about ``split_bytes`` each however large single repositories are.
The driver handles the names of the splits, never those of the files.

``landed_files`` streams a folder where files keep arriving. Its offset is the modification
time and name of the last file taken; only files that have not changed for ``settle`` seconds
are taken, so files that are being written are left for the next batch.

Both read with Python in tasks: through pyarrow's file systems, local and remote. A task that
is tried again reads its split anew. Filters on ``repo`` and ``path`` are applied before files
are opened where ``spark.sql.python.filterPushdown.enabled`` is set.
"""

import os
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith,
)

from reporank.session import scratch_root, written
from reporank.sources.raw import READ_BYTES, _content, _filesystem

SPLIT_BYTES = 64 << 20
FILE_COST = 64 << 10  # what opening a file counts besides its bytes
SETTLE = 2.0
LISTING = "repo string, path string, bytes long"
TREE = f"{LISTING}, content string"
LANDED = "path string, bytes long, modified timestamp, content string"


def _entries(system, folder):
    """(name, is a folder, bytes) of what lies in a folder; links to folders are not followed."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0
                elif not entry.is_dir():
                    try:
                        yield entry.name, False, entry.stat().st_size
                    except FileNotFoundError:  # a dangling link
                        yield entry.name, False, 0
        return
    for info in system.get_file_info(fs.FileSelector(folder)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def list_tree(spark: SparkSession, root: str, suffixes=()) -> DataFrame:
    """``(repo, path, bytes)`` of every file below ``root/<repo>/`` with one of the suffixes.

    Suffixes are compared in lower case; without any, all files are listed. One job for each
    level of folders, over all tasks; a level is written before the next one is listed.
    """
    suffixes = tuple(s.lower() for s in suffixes)
    schema = pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64())])

    def look(batches):
        system, top = _filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = [
                    {"name": f"{folder}/{name}" if folder else name, "folder": is_folder, "bytes": size}
                    for name, is_folder, size in _entries(system, f"{top.rstrip('/')}/{folder}")
                    if is_folder or not suffixes or name.lower().endswith(suffixes)
                ]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema=schema)

    level, out = spark.createDataFrame([("",)], "name string"), None
    tasks = max(1, spark.sparkContext.defaultParallelism)
    while True:
        dealt = level.select("name").repartition(tasks, F.xxhash64("name"))
        found = written(dealt.mapInArrow(look, "name string, folder boolean, bytes long"))
        # a file that lies in the root itself belongs to no repository
        files = found.filter("NOT folder AND name LIKE '%/%'").select("name", "bytes")
        out = files if out is None else out.unionByName(files)
        level = found.filter("folder")
        if level.isEmpty():
            break
    cut = F.instr("name", "/")
    return out.select(
        F.expr("substring(name, 1, instr(name, '/') - 1)").alias("repo"),
        F.substring("name", cut + 1, F.length("name")).alias("path"),
        "bytes",
    )


def write_splits(listing: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES):
    """Write a listing in one file for each split of about ``split_bytes``."""
    weight = listing.agg(F.sum(F.col("bytes") + FILE_COST)).first()[0] or 0
    splits = max(1, -(-weight // split_bytes))
    split = F.pmod(F.xxhash64("repo", "path"), F.lit(splits)).cast("int")
    rows = listing.select("repo", "path", "bytes").repartitionById(splits, split).sortWithinPartitions("repo", "path")
    rows.write.parquet(folder)


def read_tree(spark: SparkSession, root: str, suffixes=(), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(repo, path, bytes, content)`` of the files below ``root/<repo>/``, by format ``source_tree``.

    The tree is listed now, by Spark; files are read when the frame is.
    """
    listing = f"{scratch_root(spark)}/reporank-listing-{uuid.uuid4().hex}"
    write_splits(list_tree(spark, root, suffixes), listing, split_bytes)
    spark.dataSource.register(SourceTree)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("source_tree").options(path=root, listing=listing, filters=filters).load()


class Split(InputPartition):
    """One file of a listing."""

    def __init__(self, listing):
        self.listing = listing


def _data_files(folder):
    from pyarrow import fs

    system, at = _filesystem(folder)
    infos = system.get_file_info(fs.FileSelector(at))
    return sorted(i.path for i in infos if i.type == fs.FileType.File and i.base_name.startswith("part-"))


class SourceTree(DataSource):
    """Options: ``path`` (the root), ``listing`` (a folder of :func:`write_splits`), ``filters``."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        # Spark refuses a reader that takes filters unless the session lets it
        pushed = self.options.get("filters", "false") == "true"
        return FilteringTreeReader(self.options) if pushed else TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        if "listing" not in options:
            raise ValueError("give a listing: reporank.sources.tree.read_tree writes one")
        self.root, self.listing, self.tests = options["path"], options["listing"], []

    def partitions(self):
        return [Split(f) for f in _data_files(self.listing)]

    def _wanted(self, row):
        test = {
            "EqualTo": lambda x, v: x == v,
            "In": lambda x, v: x in v,
            "StringEndsWith": str.endswith,
            "StringStartsWith": str.startswith,
        }
        return all(test[kind](row[name], value) for name, kind, value in self.tests)

    def read(self, partition):
        import pyarrow.parquet as pq

        schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("content", pa.string())])
        lists, _ = _filesystem(self.listing)
        system, top = _filesystem(self.root)
        part, held = [], 0
        with lists.open_input_file(partition.listing) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=4096):
                for row in filter(self._wanted, batch.to_pylist()):
                    text = _content(system, f"{top.rstrip('/')}/{row['repo']}/{row['path']}")
                    part.append(row | {"content": text})
                    held += len(text or "") + 64
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(part, schema=schema)
                        part, held = [], 0
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=schema)


class FilteringTreeReader(TreeReader):
    def pushFilters(self, filters):
        """Takes filters on the repository and the path; others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("repo", "path") and isinstance(f, (EqualTo, In, StringEndsWith, StringStartsWith)):
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f


class LandedFiles(DataSource):
    """Options: ``path``, ``suffix`` (".json") and ``settle`` (seconds)."""

    @classmethod
    def name(cls):
        return "landed_files"

    def schema(self):
        return LANDED

    def streamReader(self, schema):
        return LandedReader(self.options)


class Files(InputPartition):
    def __init__(self, files):
        self.files = files


class LandedReader(DataSourceStreamReader):
    """Offsets are ``{"modified": nanoseconds, "name": path}`` of the last file taken."""

    def __init__(self, options):
        self.root, self.suffix = options["path"], options.get("suffix", ".json")
        self.settle = float(options.get("settle", SETTLE))

    def initialOffset(self):
        return {"modified": 0, "name": ""}

    def _landed(self):
        """(modified, name, bytes) of all files that are settled, oldest first."""
        from pyarrow import fs

        system, top = _filesystem(self.root)
        infos = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        still = time.time_ns() - int(self.settle * 1e9)
        found = [
            (i.mtime_ns, i.path, i.size)
            for i in infos
            if i.type == fs.FileType.File and i.path.endswith(self.suffix) and i.mtime_ns <= still
        ]
        return sorted(found)

    def latestOffset(self):
        found = self._landed()
        return {"modified": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start, end):
        """Files behind ``start`` up to ``end``, in splits of about ``SPLIT_BYTES``."""
        low, high = ((o["modified"], o["name"]) for o in (start, end))
        out, part, held = [], [], 0
        for modified, name, size in self._landed():
            if low < (modified, name) <= high:
                part.append((name, size, modified))
                held += size + FILE_COST
                if held >= SPLIT_BYTES:
                    out.append(Files(part))
                    part, held = [], 0
        return out + ([Files(part)] if part else [])

    def read(self, partition):
        from datetime import datetime, timezone

        system, _ = _filesystem(self.root)
        for name, size, modified in partition.files:
            at = datetime.fromtimestamp(modified / 1e9, timezone.utc)
            yield name, size, at, _content(system, name)

    def commit(self, end):
        pass


def stream_landed(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(path, bytes, modified, content)`` of the files of a folder as they land."""
    spark.dataSource.register(LandedFiles)
    reader = spark.readStream.format("landed_files").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
