"""Stored tables: queries, job status events and results, as append-only parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reporank import fixed, schemas
from reporank.functions.scores import breakdown
from reporank.operators.jobs import insert_if_absent, status_events, top
from reporank.session import exists


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one when nothing was written yet."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _append_absent(new, path, schema, key, job_id=None):
    """Append the rows whose key the table lacks, sorted so that files can be skipped by key."""
    existing = read_or_empty(new.sparkSession, path, schema)
    if job_id is not None:
        existing = existing.filter(F.col("job_id") == job_id)
    order = [F.col(c) for c in schema.names if c not in ("id", "created_at", "embedding")]
    typed = new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows = insert_if_absent(typed, existing, key, order)
    rows.sortWithinPartitions(*key).write.mode("append").parquet(path)


def save_queries(queries: DataFrame, queries_path: str, events_path: str, at) -> None:
    """Record queries ``(job_id, text, embedding)`` and open a pending job for each."""
    rows = queries.select(
        F.sha2("job_id", 256).alias("id"),
        "text",
        F.col("embedding").cast(schemas.VECTOR).alias("embedding"),
        "job_id",
        F.current_timestamp().alias("created_at"),
    )
    _append_absent(rows, queries_path, schemas.QUERIES, ["job_id"])
    opened = status_events(queries.withColumn("query", F.col("text")), "pending", at)
    _append_absent(opened, events_path, schemas.JOB_EVENTS, ["job_id", "seq"])


def append_status(jobs: DataFrame, status: str, events_path: str, at, seq: int) -> None:
    """Append a status change for every job in ``jobs`` (``job_id, query``)."""
    status_events(jobs, status, at, seq).write.mode("append").parquet(events_path)


def result_rows(ranked: DataFrame, job_id=None) -> DataFrame:
    """Ranked repositories in the shape of the results table, with defaults filled in."""
    job = F.col("job_id") if job_id is None else F.lit(job_id)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    shown = F.col("score_breakdown") if "score_breakdown" in ranked.columns else breakdown()
    return ranked.select(
        F.sha2(F.concat_ws("\n", job, "full_name"), 256).alias("id"),
        job.alias("job_id"),
        text("full_name").alias("repo_full_name"),
        text("url").alias("repo_url"),
        text("description").alias("description"),
        text("language").alias("language"),
        F.coalesce("stars", F.lit(0)).cast("long").alias("stars"),
        score("relevance_score"),
        score("quality_score"),
        score("health_score"),
        score("composite_score"),
        F.to_json(shown).alias("score_breakdown"),
        F.current_timestamp().alias("created_at"),
    )


def write_results(ranked: DataFrame, path: str, job_id=None, n: int = fixed.TOP_FULL) -> None:
    """Append the best ``n`` rows per job; rows a job already has stay as they are."""
    rows = result_rows(ranked, job_id)
    best = top(rows, n, "composite_score", "repo_full_name", None if job_id else "job_id")
    _append_absent(best, path, schemas.RESULTS, ["job_id", "repo_full_name"], job_id)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the parquet table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_results_jdbc(ranked: DataFrame, url: str, table: str = "results", job_id=None) -> None:
    """Append result rows to a database table through Spark's JDBC writer."""
    result_rows(ranked, job_id).write.mode("append").jdbc(url, table)
