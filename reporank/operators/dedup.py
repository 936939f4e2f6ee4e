"""Near-duplicate removal by LSH banding of MinHash fingerprints."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import minhash as M
from reporank.operators.components import connected_components
from reporank.operators.skew import join_lookup
from reporank.session import written


def _hash(values, by):
    """Two 64-bit hashes: a stand-in for ``values``, only equal within one batch."""
    scope = [] if by is None else [F.col(by)]
    return [F.xxhash64(F.lit(seed), *scope, *values) for seed in (1, 2)]


def _print(fingerprint, by):
    x, y = _hash([F.col(fingerprint)], by)
    return F.struct(x.alias("x"), y.alias("y"))


def _buckets(fingerprint, by):
    """Struct ``x0, y0, ... x15, y15``: per band, what its eight minima hash to.

    Plain numbers, as they sort and shuffle faster than text keys.
    """
    fields = []
    for band in range(fixed.NUM_BANDS):
        first = band * fixed.BAND_ROWS
        minima = [F.get(fingerprint, F.lit(first + i)) for i in range(fixed.BAND_ROWS)]
        x, y = _hash(minima, by)
        fields += [x.alias(f"x{band}"), y.alias(f"y{band}")]
    return F.struct(*fields)


BUCKET = ["band", "x", "y"]


def _usable(df, key, fingerprint, stars, by=None):
    """``(low, id, print, buckets)`` of the rows that can be duplicates.

    Kept first: most stars, then the smaller key, so the smallest ``(low, id)``.
    """
    return df.filter(M.has_tokens(fingerprint)).select(
        (-F.coalesce(F.col(stars), F.lit(0))).alias("low"),
        F.col(key).alias("id"),
        _print(fingerprint, by).alias("print"),
        _buckets(fingerprint, by).alias("buckets"),
    )


def _numbered(rows):
    """``rows`` with ``no``, a number that grows in keeping order; written once.

    From here on the best of several is the smallest number: one long, which hash
    aggregates handle, and names travel with none of the sixteen band rows.
    """
    order = ["low", "id"]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranked.withColumn("no", F.monotonically_increasing_id()))


def _representatives(df, key, fingerprint, stars, by=None):
    """One numbered row per distinct fingerprint: that of its best repo.

    Exact copies share every bucket, so only the best copy needs linking to others.
    """
    best = (
        _usable(df, key, fingerprint, stars, by)
        .groupBy("print")
        .agg(F.min(F.struct("low", "id")).alias("rank"), F.first("buckets").alias("buckets"))
    )
    return _numbered(best.select("rank.*", "print", "buckets"))


def _memberships(rows, *columns):
    """One row per band of every row of ``(no, buckets)``."""
    fields = []
    for band in range(fixed.NUM_BANDS):
        fields += [F.lit(band), F.col("buckets")[f"x{band}"], F.col("buckets")[f"y{band}"]]
    return rows.select("no", *columns, F.stack(F.lit(fixed.NUM_BANDS), *fields).alias(*BUCKET))


def _keepers(members):
    """Best repo and size of each bucket.

    The aggregate starts in every task, so a bucket that holds a third of all
    repos still sends one row per task.
    """
    return members.groupBy(*BUCKET).agg(F.min("no").alias("keeper"), F.count("*").alias("size"))


def band_winners(
    df, key="full_name", fingerprint="minhash_fingerprint", stars="stars", by=None
) -> DataFrame:
    """Keys that win at least one bucket: those the per-bucket rule lets through."""
    rows = _numbered(_usable(df, key, fingerprint, stars, by).drop("print"))
    won = _keepers(_memberships(rows)).select(F.col("keeper").alias("no")).distinct()
    return rows.select("no", F.col("id").alias(key)).join(won, "no", "left_semi").select(key)


def bucket_flags(df, key="full_name", fingerprint="minhash_fingerprint", stars="stars") -> DataFrame:
    """``(key, band, is_duplicate)``: per bucket, every repo but the keeper is flagged.

    Each row compares itself to its bucket's keeper, so no bucket has to be
    sorted, or even to fit, in one task.
    """
    rows = _numbered(_usable(df, key, fingerprint, stars).drop("print"))
    linked = join_lookup(_memberships(rows, "id"), _keepers(_memberships(rows)), BUCKET, "size")
    flag = F.col("no") != F.col("keeper")
    return linked.select(F.col("id").alias(key), "band", flag.alias("is_duplicate"))


def _bucket_links(best):
    """Every representative linked to the keeper of each bucket it does not win."""
    members = _memberships(best)
    shared = _keepers(members).filter("size > 1")
    linked = join_lookup(members, shared, BUCKET, "size")
    return linked.filter("no <> keeper").select("keeper", "no")


def candidate_pairs(
    df, key="full_name", fingerprint="minhash_fingerprint", stars="stars"
) -> DataFrame:
    """``(keeper, duplicate, bands)``: every repo linked to the keeper of its buckets.

    A bucket of n repos gives n - 1 links, not n * (n - 1) / 2 pairs; the links
    connect exactly the same repos. ``bands`` counts the shared buckets.
    Copies of one fingerprint hang on the best copy with all 16 bands. The
    representatives are written once, as several steps read them.
    """
    best = _representatives(df, key, fingerprint, stars)
    linked = written(_bucket_links(best).groupBy("keeper", "no").agg(F.count("*").alias("bands")))
    names = best.select(F.col("no").alias("n"), F.col("id").alias("duplicate"))
    led = linked.groupBy("keeper").agg(F.count("*").alias("size"))
    leaders = led.join(names, led["keeper"] == names["n"]).select(
        "keeper", F.col("duplicate").alias("leader"), "size"
    )
    links = join_lookup(linked, leaders, ["keeper"], "size").join(names, F.col("no") == F.col("n"))
    links = links.select(F.col("leader").alias("keeper"), "duplicate", "bands")
    return links.unionByName(_copies(df, best, key, fingerprint))


def _copies(df, best, key, fingerprint):
    """Links from each exact copy to the best copy of its fingerprint."""
    rows = df.filter(M.has_tokens(fingerprint)).select(
        F.col(key).alias("duplicate"), _print(fingerprint, None).alias("print")
    )
    sizes = rows.groupBy("print").agg(F.count("*").alias("size")).filter("size > 1")
    lookup = sizes.join(best.select("print", F.col("id").alias("keeper")), "print")
    return (
        join_lookup(rows, lookup, ["print"], "size")
        .filter("duplicate <> keeper")
        .select("keeper", "duplicate", F.lit(fixed.NUM_BANDS).cast("long").alias("bands"))
    )


def cluster_keepers(
    df, key="full_name", fingerprint="minhash_fingerprint", stars="stars", by=None
) -> DataFrame:
    """Keys kept when each connected cluster of bucket mates keeps its best repo.

    The best repo has the smallest number, which is what a component is named by.
    """
    best = _representatives(df, key, fingerprint, stars, by)
    clusters = connected_components(_bucket_links(best), "keeper", "no")
    others = clusters.filter("node <> component").select(F.col("node").alias("no"))
    return best.select("no", F.col("id").alias(key)).join(others, "no", "left_anti").select(key)


def dedup(
    df: DataFrame,
    rule: str = "cluster",
    key: str = "full_name",
    fingerprint: str = "minhash_fingerprint",
    stars: str = "stars",
    by: str | None = None,
) -> DataFrame:
    """``df`` with ``is_duplicate``; ``key`` is unique over all rows.

    With ``by``, only rows of the same batch are compared.

    ``any_band`` drops a repo that wins none of its 16 buckets; ``cluster`` keeps one
    repo per connected cluster. Both write the numbered repos, ``cluster`` its rounds
    too, before they return.
    Repos without tokens are never duplicates. Equal stars: the smaller key wins.
    """
    if rule not in ("any_band", "cluster"):
        raise ValueError("rule is any_band or cluster")
    slim = df.select(key, fingerprint, stars, *([by] if by else []))
    keepers = band_winners if rule == "any_band" else cluster_keepers
    kept = keepers(slim, key, fingerprint, stars, by)
    usable = df.withColumn("_usable", M.has_tokens(fingerprint))
    marked = usable.join(kept.withColumn("_kept", F.lit(True)), key, "left")
    return marked.withColumn(
        "is_duplicate", F.col("_usable") & F.col("_kept").isNull()
    ).drop("_usable", "_kept")


def verify_pairs(pairs: DataFrame, df: DataFrame, key="full_name", fingerprint="minhash_fingerprint"):
    """Candidate pairs with the estimated Jaccard similarity of their fingerprints.

    A keeper may have very many duplicates, so its fingerprint is looked up per
    keeper, hot ones by broadcast; duplicates are matched on their own key.
    """
    pairs = written(pairs)
    prints = df.select(F.col(key).alias("k"), F.col(fingerprint).alias("f"))
    sizes = pairs.groupBy("keeper").agg(F.count("*").alias("size"))
    kept = sizes.join(prints.select(F.col("k").alias("keeper"), F.col("f").alias("left")), "keeper")
    return (
        join_lookup(pairs, kept, ["keeper"], "size")
        .join(prints.select(F.col("k").alias("duplicate"), F.col("f").alias("right")), "duplicate")
        .withColumn("jaccard", M.jaccard_estimate("left", "right"))
        .drop("left", "right")
    )
