"""Contributor statistics of repositories from commits and issues."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.functions.scores import whole_days


def issue_close_rate(issues: DataFrame) -> DataFrame:
    """Share of issues that are closed."""
    closed = F.when(F.col("closed"), 1.0).otherwise(0.0)
    return issues.groupBy("repo").agg(F.avg(closed).alias("issue_close_rate"))


def contributor_stats(commits: DataFrame, issues: DataFrame, as_of) -> DataFrame:
    """``(repo, contributor_stats)``; what is unknown for a repo stays null.

    ``commits`` has ``repo, author, committed_at``; ``issues`` has ``repo, closed``.
    ``as_of`` is a timestamp column or literal, never the wall clock.
    """
    by_commit = commits.groupBy("repo").agg(
        F.count_distinct("author").alias("contributor_count"),
        F.max("committed_at").alias("latest"),
    )
    return by_commit.join(issue_close_rate(issues), "repo", "full").select(
        "repo",
        F.struct(
            "contributor_count",
            whole_days("latest", as_of).alias("commit_recency"),
            "issue_close_rate",
        ).alias("contributor_stats"),
    )


# mergeable counts

SKETCH_LG = 12  # 2**12 registers: about 4 KB at most for a repository and day
SKETCH_ERROR = 0.05  # stated bound of the relative error: three standard errors of 1.04 / 64


def author_sketches(commits: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """``(repo, day, authors, commits, latest)``: a sketch of the authors of each day.

    Sketches of several crawls are appended; a day that is crawled again adds nothing new.
    """
    return commits.groupBy("repo", F.to_date("committed_at").alias("day")).agg(
        F.hll_sketch_agg("author", lg).alias("authors"),
        F.count("*").alias("commits"),
        F.max("committed_at").alias("latest"),
    )


def approximate_contributors(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """``(repo, contributor_count, latest)`` from sketches, over a range of days if given.

    The count is within ``SKETCH_ERROR`` of the exact one (nearly exact for small numbers).
    :func:`contributor_stats` stays exact; this one reads no commits.
    """
    if since is not None:
        sketches = sketches.filter(F.col("day") >= since)
    if until is not None:
        sketches = sketches.filter(F.col("day") <= until)
    return sketches.groupBy("repo").agg(
        F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("contributor_count"), F.max("latest").alias("latest")
    )
