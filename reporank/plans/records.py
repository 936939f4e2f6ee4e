"""Repository records from search items, code metrics and contributor statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_fields(items: DataFrame) -> DataFrame:
    """Search items under the names of the repository record."""
    return items.select(
        "full_name",
        F.col("html_url").alias("url"),
        "description",
        "language",
        F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"),
    )


def assemble_repos(items: DataFrame, metrics: DataFrame, stats: DataFrame) -> DataFrame:
    """One record per item that has code metrics; missing statistics stay null.

    ``metrics`` is ``(full_name, ast)``, ``stats`` is ``(full_name, contributor_stats)``.
    An item whose source could not be fetched has no metrics and is left out.
    """
    return (
        item_fields(items).join(metrics, "full_name").join(stats, "full_name", "left")
    ).select(
        "full_name", "url", "description", "language", "stars", "forks", "ast", "contributor_stats"
    )
