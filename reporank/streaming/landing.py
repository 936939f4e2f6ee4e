"""Repository records that keep arriving in the raw folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reporank.sources.raw import CORRUPT, _raw_schema, _tidy, read_options


def stream_repos(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_repos``, over files as they land.

    Bounds and best rows are those of a whole job, so records are landed as a table and the
    job is ranked over it; scores that need no batch apply to the stream unchanged.
    """
    raw = spark.readStream.schema(_raw_schema()).options(**read_options()).json(path)
    return _tidy(raw.filter(F.col(CORRUPT).isNull() | F.col("full_name").isNotNull()))
