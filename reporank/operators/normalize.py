"""Min-max normalization of numeric features over a batch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.scores import rounded
from reporank.session import written


def _value(source) -> Column:
    """Missing counts as 0; a value that is not a number is null and so ignored."""
    return F.when(source.isNull(), 0.0).otherwise(source.try_cast("double"))


def _features(features):
    return features or {name: F.col("ast")[name] for name in fixed.FEATURES}


def bounds(features=None) -> Column:
    """Aggregate: struct of the lowest and highest value of every feature.

    No values at all: 0 and 1. One distinct value: highest is lowest plus 1.
    """
    parts = []
    for name, source in _features(features).items():
        low = F.coalesce(F.min(_value(source)), F.lit(0.0))
        high = F.coalesce(F.max(_value(source)), F.lit(1.0))
        parts.append(low.alias(f"{name}_lo"))
        parts.append(F.when(low == high, low + 1).otherwise(high).alias(f"{name}_hi"))
    return F.struct(*parts)


def scaled(value, lo, hi) -> Column:
    """Position of a value between its bounds, rounded."""
    return rounded((value - lo) / (hi - lo))


def scaled_features(stats, features=None) -> Column:
    """Struct of ``<feature>_norm`` given the struct made by :func:`bounds`."""
    return F.struct(
        *[
            scaled(_value(source), stats[f"{name}_lo"], stats[f"{name}_hi"]).alias(f"{name}_norm")
            for name, source in _features(features).items()
        ]
    )


def minmax_normalize(df: DataFrame, by: str | None = None, features=None) -> DataFrame:
    """``df`` with a ``normalized`` struct.

    The bounds are one row per batch: without ``by`` a scalar subquery, so no row
    of ``df`` moves. With ``by`` they are written, one row per batch, and joined: few of them
    are broadcast by their known size; of many, adaptive execution splits hot batches.
    """
    if by is None:
        stats = df.agg(bounds(features).alias("stats")).scalar()
        staged = df.withColumn("_stats", stats)
    else:
        stats = written(df.groupBy(F.col(by).alias("_batch")).agg(bounds(features).alias("_stats")))
        staged = df.join(stats, df[by].eqNullSafe(stats["_batch"])).drop("_batch")
    return staged.withColumn("normalized", scaled_features(F.col("_stats"), features)).drop(
        "_stats"
    )
