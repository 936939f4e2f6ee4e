"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame functions only).

Every partition's rows make one run: their digests, sorted, with the largest (or smallest)
identifier and the number of rows of each. In each round, runs whose numbers agree but for
the last digit (base ``fan_in``) are exchanged and merged, as in a binomial tree, until one
run is left. A run is spread over all tasks by digest, so no task ever holds a whole run,
and a digest arrives at a merge with at most ``fan_in`` rows, however many copies there are.

Two texts count as equal if SHA-256, XXH64 and length agree at every level: texts that
collide in one of them stay apart.

Defined cases: null text is empty text; empty texts are equal to each other; rows without
identifier never win against one that has it (keep_id is null if all lack it) and are not
kept; rows that repeat text and identifier are all kept or all dropped; other columns are
ignored; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.common import lower_ascii
from reporank.session import written

DIGEST = ["sha", "xx", "n_bytes"]


def _digests(docs, id_column, text_column):
    text = lower_ascii(F.coalesce(F.col(text_column), F.lit("")))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    return rows.select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.xxhash64("text").alias("xx"),
        F.octet_length("text").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
    )


def _least(identifier):
    """Smallest identifier; null, which sorts first, only if there is no other."""
    return F.min(F.struct(F.isnull(identifier["id"]).alias("none"), identifier["id"].alias("id")))


def _merged(runs, best, fan_in):
    """One round: the runs of each group of ``fan_in`` merged to one.

    An extreme of a struct is aggregated by sorting: each task sorts and merges what it
    has before the exchange, and merges the sorted pieces it receives after it.
    """
    group = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    return (
        runs.groupBy(group, *DIGEST)
        .agg(best(F.struct("id")).alias("best"), F.sum("size").alias("size"))
        .select("run", *DIGEST, F.col("best.id").alias("id"), "size")
    )


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "largest",
    fan_in: int = 8,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    best = {"largest": F.max, "smallest": _least}[keep]
    rows = written(_digests(docs, id_column, text_column))
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.withColumn("size", F.lit(1).cast("long"))
    while True:
        runs, last = _merged(runs, best, fan_in), last // fan_in
        if not last:
            break
    winners = runs.select(*DIGEST, F.col("id").alias("keep_id"), F.col("size").alias("group_size"))
    return rows.join(winners, DIGEST).select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
