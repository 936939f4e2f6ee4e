"""What several operators share: normalised text, words, worker-wide objects."""

import sys
import types
import uuid

from pyspark.sql import functions as F

from reporank.session import dropped, scratch_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 text: A-Z lower-cased, other ASCII that is no digit or letter becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text):
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in; other text is translated."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str | None) -> list[bytes]:
    """Words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def worker_wide(name, make):
    """One object per Python worker process, kept from task to task."""
    held = sys.modules.setdefault("reporank_worker_wide", types.ModuleType("reporank_worker_wide"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)




def bucketed(df, key, partitions):
    """Write `df` to the shared folder in buckets of `key`, one per shuffle partition.

    Joins on the key then read the table where it lies instead of shuffling it. Returns the
    table and a function that deletes it.
    """
    spark, name = df.sparkSession, f"reporank_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    spread = df.write.bucketBy(partitions, key).option("path", path).option("compression", "zstd")
    spread.saveAsTable(name)

    def delete():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(spark, path)

    return spark.table(name), delete
