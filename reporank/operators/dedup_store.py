"""Near-duplicate removal over batches: a stored index that takes what is new.

A folder keeps, for every batch that was added, what its repositories hash to and how they
hang together, so a new batch is compared with all earlier ones without their fingerprints
or texts:

* ``repos``: ``(id, low, print)`` of each repository, print null where there are no tokens;
* ``prints``: ``(print, component)`` of each new fingerprint, ``component`` as of that batch;
* ``members``: its buckets ``(band, x, y, print)``;
* ``owners``: ``(band, x, y, print)``, the print that opened a bucket, once per bucket;
* ``renamed``: ``(component, now)`` for every component that later batches merged, complete
  for the batch it is written with; only the latest one is read.

A new print is linked to the owner of each of its buckets. Old prints stand for their
components: the graph that is searched holds the new prints and the components they touch,
never the rest. Adding two halves of a batch, in any order, gives the rows that
:func:`reporank.operators.dedup.dedup` gives for the whole.

Each batch is written below its own name and becomes visible by a marker that is written
last: a batch that was interrupted is not read, and can be added again. One writer at a time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import minhash as M
from reporank.operators.components import connected_components
from reporank.session import dropped, exists, written

BUCKET = ["band", "x", "y"]
TABLES = {
    "repos": "id string, low long, print string",
    "prints": "print string, component string",
    "members": "band int, x long, y long, print string",
    "owners": "band int, x long, y long, print string",
    "renamed": "component string, now string",
}
MARK = "batch string, at long"


def _batches(spark, folder) -> list[str]:
    """Names of the finished batches, oldest first."""
    if not exists(spark, f"{folder}/finished"):
        return []
    rows = spark.read.schema(MARK).parquet(f"{folder}/finished").orderBy("at").collect()  # one row a batch
    return [r.batch for r in rows]


def _read(spark, folder, name, batches) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], TABLES[name])
    paths = [f"{folder}/{name}/{b}" for b in batches]
    # ids have the type they came with
    reader = spark.read if name == "repos" else spark.read.schema(TABLES[name])
    return reader.parquet(*paths)


def _hashed(df, key, fingerprint, stars):
    """``(id, low, print, buckets)``; repositories without tokens have neither of the last two."""
    buckets = []
    for band in range(fixed.NUM_BANDS):
        minima = [F.get(fingerprint, F.lit(band * fixed.BAND_ROWS + i)) for i in range(fixed.BAND_ROWS)]
        halves = [F.xxhash64(F.lit(seed), *minima).alias(c) for seed, c in ((1, "x"), (2, "y"))]
        buckets.append(F.struct(F.lit(band).alias("band"), *halves))
    filled = M.has_tokens(fingerprint)
    text = F.array_join(F.col(fingerprint).cast("array<string>"), ",")
    return df.select(
        F.col(key).alias("id"),
        (-F.coalesce(F.col(stars), F.lit(0))).cast("long").alias("low"),
        F.when(filled, F.md5(text)).alias("print"),
        F.when(filled, F.array(*buckets)).alias("buckets"),
    )


def _current(spark, folder, batches) -> DataFrame:
    """``(print, component)`` of every stored print, by what its component is called now."""
    prints = _read(spark, folder, "prints", batches)
    renamed = _read(spark, folder, "renamed", batches[-1:])
    named = prints.join(renamed, "component", "left")
    return named.select("print", F.coalesce("now", "component").alias("component"))


def add_batch(df: DataFrame, folder: str, batch: str, key="full_name", fingerprint="minhash_fingerprint", stars="stars"):
    """Take the repositories of ``df`` in; ids that are stored already are left as they are.

    Within a batch an id occurs once. A batch that is finished is not added again.
    """
    spark = df.sparkSession
    batches = _batches(spark, folder)
    if batch in batches:
        return
    for name in TABLES:
        if exists(spark, f"{folder}/{name}/{batch}"):
            dropped(spark, f"{folder}/{name}/{batch}")  # left by an interrupted run

    def landed(rows, name):
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.parquet(f"{folder}/{name}/{batch}")
        return _read(spark, folder, name, [batch])

    rows = written(_hashed(df.select(key, fingerprint, stars), key, fingerprint, stars))
    if batches:
        known = _read(spark, folder, "repos", batches)
        rows = rows.join(known.select("id"), "id", "left_anti")
    repos = landed(rows, "repos")
    # prints that no batch had yet, with their buckets
    fresh = rows.filter("print IS NOT NULL").groupBy("print").agg(F.first("buckets").alias("buckets"))
    fresh = written(fresh.join(_read(spark, folder, "prints", batches).select("print"), "print", "left_anti"))
    members = landed(fresh.select("print", F.inline("buckets")), "members")
    # the owner of a bucket: the stored one, or else the smallest new print, which is then stored
    own = members.groupBy(*BUCKET).agg(F.min("print").alias("least"), F.count("*").alias("n"))
    stored = _read(spark, folder, "owners", batches).withColumnRenamed("print", "owner")
    owned = written(own.join(stored, BUCKET, "left"))
    landed(owned.filter("owner IS NULL").withColumnRenamed("least", "print"), "owners")
    shared = written(
        owned.filter("owner IS NOT NULL OR n > 1").select(*BUCKET, F.coalesce("owner", "least").alias("owner"))
    )
    links = members.join(shared, BUCKET).filter("print <> owner").select("print", "owner").distinct()
    # old owners stand for their components
    current = _current(spark, folder, batches)
    links = written(links.join(current.withColumnRenamed("print", "owner"), "owner", "left"))
    links = links.select("print", F.coalesce("component", "owner").alias("other"))
    found = written(connected_components(links, "print", "other"))
    labelled = fresh.select("print").join(found, F.col("print") == F.col("node"), "left")
    landed(labelled.select("print", F.coalesce("component", "print").alias("component")), "prints")
    # components that hang together now, and what earlier names have become by that
    merged = found.join(fresh, F.col("node") == F.col("print"), "left_anti").filter("node <> component")
    merged = merged.select(F.col("node").alias("was"), F.col("component").alias("is"))
    before = _read(spark, folder, "renamed", batches[-1:])
    later = before.join(merged, F.col("now") == F.col("was"), "left")
    later = later.select("component", F.coalesce("is", "now").alias("now"))
    landed(later.unionByName(merged.select(F.col("was").alias("component"), F.col("is").alias("now"))), "renamed")
    mark = spark.createDataFrame([(batch, len(batches))], MARK).coalesce(1)
    mark.write.mode("append").parquet(f"{folder}/finished")
    return repos


def stored_flags(spark, folder: str, rule: str = "cluster") -> DataFrame:
    """``(id, is_duplicate)`` of every repository of all batches, by hashes alone.

    Rules are those of ``dedup``: ``cluster`` keeps the best repository of a component,
    ``any_band`` those that are the best of one of their buckets at least.
    """
    if rule not in ("any_band", "cluster"):
        raise ValueError("rule is any_band or cluster")
    batches = _batches(spark, folder)
    repos = _read(spark, folder, "repos", batches)
    best = F.min(F.struct("low", "id")).alias("best")
    by_print = written(repos.filter("print IS NOT NULL").groupBy("print").agg(best))
    if rule == "cluster":
        named = written(_current(spark, folder, batches).join(by_print, "print"))
        kept = named.groupBy("component").agg(F.min("best").alias("best"))
    else:
        members = _read(spark, folder, "members", batches).join(by_print, "print")
        kept = members.groupBy(*BUCKET).agg(F.min("best").alias("best"))
    winners = kept.select(F.col("best.id").alias("id")).distinct().withColumn("_kept", F.lit(True))
    marked = repos.join(winners, "id", "left")
    return marked.select("id", (F.col("print").isNotNull() & F.col("_kept").isNull()).alias("is_duplicate"))
