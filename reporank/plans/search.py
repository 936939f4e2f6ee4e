"""Answering queries from earlier results where a similar query was asked before."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed, schemas
from reporank.functions.text import is_blank
from reporank.functions.vectors import cosine_to
from reporank.operators.jobs import latest_status, top
from reporank.operators.nearest import nearest_stored
from reporank.operators.vector_index import PROBES, nearest_indexed
from reporank.plans.ranking import rank_jobs, rank_pools
from reporank.session import written
from reporank.sources.tables import append_status, read_or_empty, save_queries, write_results


def reusable(
    stored: DataFrame, events: DataFrame | None = None, any_status: bool = False
) -> DataFrame:
    """Stored queries whose job is done by ``events``; with ``any_status``, all of them."""
    if any_status:
        return stored
    if events is None:
        raise ValueError("give the status events, or any_status=True")
    done = latest_status(events).filter(F.col("status") == "done").select("job_id")
    return stored.join(done, "job_id", "left_semi")


def find_cached_job(
    stored: DataFrame, vector, threshold: float = fixed.CACHE_SIMILARITY
) -> DataFrame:
    """Job of the stored query nearest to one given vector: one row, or none.

    One scan of ``stored`` with a partial top-1 per task.
    """
    scored = stored.filter(F.size("embedding") > 0).select(
        "job_id", cosine_to(vector, "embedding").alias("similarity")
    )
    nearest = scored.orderBy(F.desc("similarity"), "job_id").limit(1)
    return nearest.filter(F.col("similarity") >= threshold)


def valid_queries(incoming: DataFrame) -> DataFrame:
    return incoming.filter(~is_blank("text"))


def rejected_queries(incoming: DataFrame) -> DataFrame:
    return incoming.filter(is_blank("text"))


def search(
    incoming: DataFrame,
    stored: DataFrame,
    events: DataFrame | None = None,
    any_status: bool = False,
    index: str | None = None,
    probes: int = PROBES,
) -> DataFrame:
    """``(query_id, job_id, cached)`` for every non-blank query.

    A query near a reusable stored one gets that job; any other gets a new job
    id, derived from its own id so that a retried task gives the same one.
    With ``index``, the folder of an index of ``stored``, only the cells around a query are
    read: a match outside of them is missed, and the query gets a new job.
    """
    asked = valid_queries(incoming)
    if index is None:
        hits = nearest_stored(asked, reusable(stored, events, any_status))
    else:
        allowed = None if any_status else reusable(stored.select("job_id"), events)
        hits = nearest_indexed(asked, index, probes=probes, allowed=allowed)
    fresh = F.sha2(F.col("query_id").cast("string"), 256)
    return asked.join(hits, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("job_id").cast("string"), fresh).alias("job_id"),
        F.col("job_id").isNotNull().alias("cached"),
    )


def run_searches(
    incoming: DataFrame, candidates: DataFrame, folder: str, at, rule: str = "cluster", pool: str | None = None
):
    """Answer every non-blank query; ``(query_id, job_id, cached)`` with its best results.

    ``incoming`` has ``query_id, text, embedding``; ``candidates`` the crawled repositories
    of each query, by ``query_id``, or with ``pool`` those of each pool: both have that column,
    and queries of one pool have the same candidates, which are not copied for them. Tables ``queries``, ``events`` and ``results`` lie below
    ``folder``. Queries near one whose job is done get that job's stored results. All others
    are saved, ranked together in one plan and stored; their jobs go from pending over
    running to done, or to failed if the ranking fails.
    """
    spark = incoming.sparkSession
    queries, events, results = (f"{folder}/{name}" for name in ("queries", "events", "results"))
    stored = read_or_empty(spark, queries, schemas.QUERIES)
    log = read_or_empty(spark, events, schemas.JOB_EVENTS)
    asked = written(search(incoming, stored, log))
    new = asked.filter("NOT cached").join(incoming, "query_id").drop("cached")
    new = written(new.select("query_id", "job_id", "text", "embedding", *([pool] if pool else [])))
    save_queries(new, queries, events, at)
    jobs = new.select("job_id", F.col("text").alias("query"))
    append_status(jobs, "running", events, at, 1)
    try:
        if pool:
            ranked = rank_pools(candidates, new.select("job_id", "embedding", pool), pool, rule=rule)
        else:
            found = candidates.join(new.select("query_id", "job_id"), "query_id").drop("query_id")
            ranked = rank_jobs(found, new.select("job_id", "embedding"), rule=rule)
        write_results(ranked, results)
    except Exception:
        append_status(jobs, "failed", events, at, 2)
        raise
    append_status(jobs, "done", events, at, 2)
    rows = read_or_empty(spark, results, schemas.RESULTS).drop("id", "created_at")
    rows = rows.join(asked.select("job_id").distinct(), "job_id", "left_semi")
    best = top(rows, fixed.TOP_READ, "composite_score", "repo_full_name", by="job_id")
    return asked.join(best, "job_id")
