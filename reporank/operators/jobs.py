"""Keys, statuses and stored results."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank import fixed


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One whole row per key: the smallest by ``order`` (partial aggregates, no window)."""
    row = F.struct(*df.columns)
    picked = df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def last_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One whole row per key: the largest by ``order``, as when later writes win."""
    row = F.struct(*df.columns)
    picked = df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def insert_if_absent(
    new: DataFrame, existing: DataFrame, key: list[str], order: list | None = None
) -> DataFrame:
    """Rows of ``new`` to append: keys not in ``existing``, one row per key."""
    once = first_per_key(new, key, order or [F.col(c) for c in new.columns])
    return once.join(existing.select(*key).distinct(), key, "left_anti")


def latest_status(events: DataFrame) -> DataFrame:
    """Current status per job from its status events."""
    newest = F.struct("updated_at", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", newest).alias("status"), F.max("updated_at").alias("updated_at")
    )


def job_status(events: DataFrame, job_id: str) -> DataFrame:
    """Status of one job; no row when the job is unknown."""
    return latest_status(events.filter(F.col("job_id") == job_id)).select("status")


def status_events(job_ids: DataFrame, status: str, at, seq: int = 0) -> DataFrame:
    """Status rows to append for every job in ``job_ids``."""
    if status not in fixed.JOB_STATES:
        raise ValueError(f"status is one of {fixed.JOB_STATES}")
    return job_ids.select(
        "job_id",
        F.lit(status).alias("status"),
        "query",
        F.lit(at).cast("timestamp").alias("updated_at"),
        F.lit(seq).cast("long").alias("seq"),
    )


def orphans(results: DataFrame, queries: DataFrame, key: str = "job_id") -> DataFrame:
    """Results that refer to no query."""
    return results.join(queries.select(key).distinct(), key, "left_anti")


def referenced(results: DataFrame, queries: DataFrame, key: str = "job_id") -> DataFrame:
    """Results that refer to a query; what remains after a cascading delete."""
    return results.join(queries.select(key).distinct(), key, "left_semi")


def top(df: DataFrame, n: int, score: str, tie: str, by: str | None = None) -> DataFrame:
    """Best ``n`` rows by score then tie-break, over all rows or per ``by`` key.

    Both forms cut to ``n`` within each task before anything is shuffled.
    """
    order = [F.desc_nulls_last(score), F.asc(tie)]
    if by is None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def fetch_results(results: DataFrame, job_id, n: int = fixed.TOP_READ) -> DataFrame:
    """The stored results of one job, best first, as read by the results page."""
    chosen = results.filter(F.col("job_id") == job_id).select(
        "repo_full_name",
        "repo_url",
        "description",
        "language",
        "stars",
        "relevance_score",
        "quality_score",
        "health_score",
        "composite_score",
        "score_breakdown",
    )
    return top(chosen, n, "composite_score", "repo_full_name")
