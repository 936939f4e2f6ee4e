"""An append-only table by key in which an insert reads only files that may hold its keys.

Rows lie in one directory for each bucket of the key's hash, and files carry a Parquet Bloom
filter of the key. Inserting rows whose key is absent reads the buckets of the new keys only.
Up to ``LISTED`` different new keys are also pushed down as an IN filter, so Parquet skips the
row groups whose ranges, dictionaries and Bloom filters rule all of them out; of a larger
batch nearly every row group would be read anyway.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reporank.operators.jobs import first_per_key
from reporank.session import exists, written

BUCKETS = 64
LISTED = 2000  # new keys that are pushed down, at most
BUCKET = "_bucket"


def _bucketed(df, key, buckets):
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def read_keyed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table with its bucket column; a filter on that prunes directories."""
    whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    if not exists(spark, folder):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(folder)


def candidates(new: DataFrame, folder: str, schema, key: str, listed: int = LISTED) -> DataFrame:
    """Stored keys that can be among those of ``new`` (written, with its bucket column)."""
    spark = new.sparkSession
    buckets = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most the number of buckets
    stored = read_keyed(spark, folder, schema).filter(F.col(BUCKET).isin(buckets))
    keys = [r[0] for r in new.select(key).distinct().limit(listed + 1).collect()]
    if len(keys) <= listed:
        stored = stored.filter(F.col(key).isin(keys))
    return stored.select(key)


def insert_absent(new: DataFrame, folder: str, key: str, order: list | None = None, buckets: int = BUCKETS, listed: int = LISTED) -> DataFrame:
    """Append the rows whose key the table lacks, one row per key (the smallest by ``order``).

    Returns the rows that were added. Rows without key are not stored. ``buckets`` stays the
    same for the life of a table. One writer at a time.
    """
    schema = new.schema
    once = first_per_key(new.filter(F.col(key).isNotNull()), [key], order or [F.col(c) for c in new.columns])
    rows = written(_bucketed(once, key, buckets))
    absent = written(rows.join(candidates(rows, folder, schema, key, listed), key, "left_anti").select(*rows.columns))
    partitions = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = absent.repartition(partitions, BUCKET).sortWithinPartitions(BUCKET, key)
    spread = dealt.write.mode("append").partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true")
    # without it the dictionary of a file with unique keys would be tried before the filter
    spread.option(f"parquet.enable.dictionary#{key}", "false").parquet(folder)
    return absent.drop(BUCKET)
