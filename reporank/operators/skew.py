"""Joins that stay balanced when one key holds a large share of the rows."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reporank.session import written


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join of ``rows`` to ``lookup``, which has one row per key; null keys are keys too.

    ``weight`` is the column of ``lookup`` counting the rows of each key. A key with more
    than its task's share of all rows (total / shuffle partitions) gets as many salts as it
    has shares: its rows are dealt out by their hash, and its lookup row is repeated once
    per salt. So no task gets much more than two shares of one key, whatever the sizes are.
    At most as many keys as there are partitions can have salts, which bounds what is
    broadcast. ``rows`` is read once; ``lookup`` is written once and small.
    """
    seen = Observation()
    small = written(lookup.observe(seen, F.sum(weight).alias("total")))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1.0, (seen.get["total"] or 0) / partitions)
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    salted = small.withColumn("_salts", F.ceil(F.col(weight) / share).cast("int"))
    salted = salted.drop(weight).withColumnsRenamed(named)
    hot = F.broadcast(salted.filter("_salts > 1").select(*named.values(), "_salts"))

    def same(left, right):
        return reduce(and_, [left[k].eqNullSafe(right[name]) for k, name in named.items()])

    spots = [c for c, kind in rows.dtypes if not kind.startswith("map") and "map<" not in kind]
    dealt = rows.join(hot, same(rows, hot), "left")
    dealt = dealt.withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spots), "_salts")).cast("int")
    ).drop(*named.values(), "_salts")
    spread = salted.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.greatest("_salts", F.lit(1)) - 1)))
    spread = spread.drop("_salts")
    met = dealt.join(spread, same(dealt, spread) & (dealt["_salt"] == spread["_spread"]), how)
    return met.drop("_salt", "_spread", *named.values())

