"""Where intermediate tables go."""

import tempfile
import uuid
from contextlib import contextmanager

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder: on a cluster, executors could not see it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder")
    folder = tempfile.mkdtemp(prefix="reporank-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def written_at(df):
    """Write ``df`` as a table in the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/reporank-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage once and for all: a lost executor costs a re-read, not a
    re-run, and the plan is executed once (a checkpoint would run it twice).
    """
    return written_at(df)[0]


@contextmanager
def shuffles_freed(spark):
    """Shuffle files of what is executed meanwhile go when it is done.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def _place(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark, path) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def dropped(spark, path):
    """Delete a table of ``written_at`` that nothing reads any more."""
    files, place = _place(spark, path)
    files.delete(place, True)
