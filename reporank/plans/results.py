"""Rows of the results page."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import present as P
from reporank.operators.jobs import top


def present(results: DataFrame, n: int = fixed.TOP_READ) -> DataFrame:
    """The best ``n`` results with display rank and texts.

    The rank window has one partition, but only the ``n`` rows of the limit.
    """
    best = top(results, n, "composite_score", "repo_full_name")
    order = Window.orderBy(F.desc("composite_score"), "repo_full_name")
    return best.select(
        F.row_number().over(order).alias("rank"),
        "repo_full_name",
        P.or_else("language", fixed.NO_LANGUAGE).alias("language_badge"),
        P.language_color("language").alias("language_color"),
        P.grouped_number("stars").alias("stars_label"),
        P.percent("composite_score").alias("composite"),
        P.score_class("composite_score").alias("score_class"),
        P.or_else(P.shortened("description"), fixed.NO_DESCRIPTION).alias("description"),
        P.percent("relevance_score").alias("relevance"),
        P.percent("quality_score").alias("quality"),
        P.percent("health_score").alias("health"),
        P.breakdown_labels("score_breakdown").alias("breakdown"),
    )


def result_count(results: DataFrame) -> DataFrame:
    """Number of results per job."""
    return results.groupBy("job_id").agg(F.count("*").alias("count"))
