"""Full and metadata-only ranking.

The full rankings write intermediate tables (numbered repositories, cluster rounds, batch
sizes) before they return; the final steps are one lazy plan.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import scores as S
from reporank.functions.text import embedding_text, keywords
from reporank.functions.vectors import cosine_rows, cosine_to, embed
from reporank.operators.dedup import dedup
from reporank.operators.jobs import last_per_key, top
from reporank.operators.normalize import minmax_normalize
from reporank.operators.pools import near_best
from reporank.operators.skew import join_lookup
from reporank.session import written


def search_candidates(
    repos: DataFrame,
    query: str,
    n: int = fixed.CANDIDATES_FULL,
    stars: str = "stars",
    fields=("full_name", "description"),
) -> DataFrame:
    """Most starred ``n`` repositories whose text contains every keyword of ``query``."""
    text = F.lower(F.concat_ws(" ", *fields))
    words = keywords(F.lit(query))
    found = repos.filter((F.size(words) > 0) & F.forall(words, lambda w: text.contains(w)))
    return top(found, n, stars, "full_name")


def with_relevance(repos: DataFrame, query_vector, vector: str = "embedding") -> DataFrame:
    """Relevance is the rounded cosine of the query and the repo vector, 0 without one."""
    staged = repos.withColumn("_cosine", cosine_to(query_vector, vector))
    score = F.coalesce(S.rounded(F.col("_cosine")), F.lit(0.0))
    return staged.withColumn("relevance_score", score).drop("_cosine")


def with_embedding(repos: DataFrame, make_encoder=None) -> DataFrame:
    """Vector of the description and the first ten signatures."""
    text = embedding_text("description", F.col("ast.function_signatures"))
    return repos.withColumn("embedding", embed(text, make_encoder))


def with_quality(repos: DataFrame) -> DataFrame:
    """Quality of ``repos``, which carry ``ast`` and ``normalized``."""
    score = S.quality(
        F.col("ast.test_file_ratio"),
        F.col("ast.error_handling_density"),
        F.col("normalized.public_api_count_norm"),
    )
    return repos.withColumn("quality_score", score)


def with_health(repos: DataFrame) -> DataFrame:
    stats = F.col("contributor_stats")
    score = S.health(
        stats["commit_recency"], stats["contributor_count"], stats["issue_close_rate"]
    )
    return repos.withColumn("health_score", score)


def with_composite(repos: DataFrame) -> DataFrame:
    """Composite score and its breakdown, given the three scores."""
    score = S.composite("relevance_score", "quality_score", "health_score")
    return repos.withColumns({"composite_score": score, "score_breakdown": S.breakdown()})


def _batch(repos, rule, key, by=None):
    """Repositories without duplicates, with ``normalized``; fingerprints stay behind."""
    slim = repos.withColumn("_print", F.col("ast.minhash_fingerprint")).withColumn(
        "ast", F.col("ast").dropFields("minhash_fingerprint")
    )
    kept = dedup(slim, rule, key, "_print", by=by).filter("NOT is_duplicate")
    return minmax_normalize(kept.drop("_print", "is_duplicate"), by)


def latest_records(repos: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One record per repository: the last by ``order``, then by a hash of its content, so that
    the choice never depends on the order of the rows."""
    return last_per_key(repos, keys, [*(order or []), F.xxhash64(*repos.columns)])


def rank_repos(
    repos: DataFrame,
    query_vector,
    k: int = fixed.TOP_FULL,
    rule: str = "cluster",
    make_encoder=None,
    order: list | None = None,
) -> DataFrame:
    """Best ``k`` repositories for a query vector.

    Of several records under one name the last counts (``order``: columns that tell).
    Duplicates leave before the batch bounds are taken, as they would shift them.
    A given ``embedding`` is scored before the dedup shuffle, so vectors do not
    travel; a missing one is computed after it, for the survivors only.
    """
    given = "embedding" in repos.columns
    if given:
        repos = with_relevance(repos, query_vector).drop("embedding")
    batch = _batch(latest_records(repos, ["full_name"], order), rule, "full_name")
    if not given:
        batch = with_relevance(with_embedding(batch, make_encoder), query_vector).drop("embedding")
    scored = with_composite(with_health(with_quality(batch)))
    return top(scored, k, "composite_score", "full_name")


def rank_jobs(
    repos: DataFrame,
    queries: DataFrame,
    k: int = fixed.TOP_FULL,
    rule: str = "cluster",
    order: list | None = None,
) -> DataFrame:
    """Best ``k`` repositories of every job, all jobs together.

    Of several records under one name in a job the last counts (``order``: columns that tell).

    ``repos`` carries ``job_id`` and ``embedding``; ``queries`` has one
    ``(job_id, embedding)`` per job (without it, relevance is 0). Each job is deduplicated, normalized and cut
    to ``k`` by itself, and a job may hold most of the rows: its vector and its
    bounds are looked up by broadcast, and its best rows are cut in every task.
    """
    sizes = repos.groupBy("job_id").agg(F.count("*").alias("_size"))
    asked = queries.select("job_id", F.col("embedding").alias("_asked"))
    paired = join_lookup(repos, sizes.join(asked, "job_id", "left"), ["job_id"], "_size")
    staged = paired.withColumn("_cosine", cosine_rows("embedding", "_asked"))
    scored = staged.withColumns(
        {
            "relevance_score": F.coalesce(S.rounded(F.col("_cosine")), F.lit(0.0)),
            "_key": F.concat_ws("\n", F.col("job_id").cast("string"), "full_name"),
        }
    ).drop("embedding", "_asked", "_cosine")
    scored = latest_records(scored, ["_key"], order)
    batch = _batch(scored, rule, "_key", by="job_id").drop("_key")
    ranked = with_composite(with_health(with_quality(batch)))
    return top(ranked, k, "composite_score", "full_name", by="job_id")


def rank_pools(
    repos: DataFrame, queries: DataFrame, pool: str, k: int = fixed.TOP_FULL, rule: str = "cluster"
) -> DataFrame:
    """:func:`rank_jobs` where the jobs of a pool have the same candidates; same rows.

    ``repos`` carries ``pool`` and ``embedding``, each repository once per pool; ``queries`` has
    ``(job_id, embedding, pool)``. Duplicates, bounds and the scores without the question are
    taken once per pool, and repositories are not copied for every job: what is stored and
    shuffled grows with repositories, jobs and results, not with jobs times repositories.

    Of different records under one name every job takes its own, by a hash that has the job in
    it. Pools with such names are ranked job by job, with copies, as :func:`rank_jobs` does.
    """
    repos = repos.drop("job_id")
    content = F.xxhash64(*repos.columns)
    named = repos.groupBy(pool, "full_name").agg((F.min(content) != F.max(content)).alias("mixed"))
    mixed = written(named.filter("mixed").select(pool).distinct())
    shared = _rank_shared(repos.join(mixed, pool, "left_anti"), queries.join(mixed, pool, "left_anti"), pool, k, rule)
    if mixed.isEmpty():
        return shared
    jobs = queries.join(mixed, pool, "left_semi")
    copied = repos.join(jobs.select("job_id", pool), pool).drop(pool)
    return shared.unionByName(rank_jobs(copied, jobs.select("job_id", "embedding"), k, rule).select(*shared.columns))


def _rank_shared(repos, queries, pool, k, rule):
    keyed = repos.withColumn("_key", F.concat_ws("\n", F.col(pool).cast("string"), "full_name"))
    batch = _batch(latest_records(keyed, ["_key"]), rule, "_key", by=pool).drop("_key")
    scored = with_health(with_quality(batch)).withColumn("_no", F.monotonically_increasing_id())
    scored = written(scored)
    slim = scored.select(F.col("_no").alias("no"), pool, "full_name", "embedding", "quality_score", "health_score")
    asked = queries.select("job_id", "embedding", pool)
    asked = written(asked.groupBy("job_id", pool).agg(F.max_by("embedding", F.xxhash64("embedding")).alias("embedding")))
    near = near_best(slim, asked, pool, k).withColumn("relevance_score", F.coalesce(S.rounded(F.col("cosine")), F.lit(0.0)))
    near = near.withColumn("composite_score", S.composite("relevance_score", "quality_score", "health_score"))
    best = top(near, k, "composite_score", "full_name", by="job_id")
    best = best.select("job_id", F.col("no").alias("_no"), "relevance_score")
    return with_composite(scored.drop("embedding", pool).join(best, "_no").drop("_no"))


def lite_scores(items: DataFrame, as_of, query_vector=None) -> DataFrame:
    """Scores of search items from public metadata; the composite is not rounded.

    Relevance is 0.5 for an item without ``embedding`` and 0 without a query vector.
    """
    default = F.lit(fixed.LITE_DEFAULT_RELEVANCE)
    if "embedding" not in items.columns:
        relevance = default
    elif query_vector:
        relevance = F.coalesce(cosine_to(query_vector, "embedding"), default)
    else:
        relevance = F.when(F.col("embedding").isNull(), default).otherwise(0.0)
    staged = items.withColumns(
        {
            "relevance_score": relevance,
            "quality_score": S.lite_quality("description", "stargazers_count", "forks_count"),
            "health_score": S.lite_health("updated_at", "open_issues_count", as_of),
        }
    )
    parts = ["relevance_score", "quality_score", "health_score"]
    return staged.withColumns(
        {
            "composite_score": S.weighted(*parts),
            "score_breakdown": F.struct(
                *[F.col(p).alias(p.removesuffix("_score")) for p in parts],
                F.col("stargazers_count").alias("stars"),
            ),
        }
    )


def lite_embedding_text(description="description", topics="topics"):
    """Description and all topics, space-joined."""
    return embedding_text(description, topics, limit=None)


def rank_lite(items: DataFrame, as_of, k: int = fixed.TOP_LITE, query_vector=None) -> DataFrame:
    """The ``k`` most starred items, scored and then sorted by composite score."""
    chosen = top(items, k, "stargazers_count", "full_name")
    return lite_scores(chosen, as_of, query_vector).orderBy(F.desc("composite_score"), "full_name")


def lite_records(ranked: DataFrame) -> DataFrame:
    """Ranked search items under the names the results table is filled from."""
    return ranked.withColumnsRenamed(
        {"html_url": "url", "stargazers_count": "stars", "forks_count": "forks"}
    )
