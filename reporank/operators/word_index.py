"""A stored inverted index over repository texts: whole words to repositories, by stars.

Postings ``(word, key, stars)`` lie in directories by ``bucket`` (a hash of the word) and
``tier`` (a band of stars, the most starred first). A search reads the buckets of its words,
tier after tier, and stops as soon as it has ``n`` repositories that hold all of them: whatever
is in a later tier has fewer stars. Tier limits are quantiles of the first build; they decide
how much is read, not what is found.

A word is a maximal run of a-z and 0-9 in the lower-cased text, so this finds whole words,
where :func:`reporank.plans.ranking.search_candidates` also finds parts of words. That one
stays the default.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.text import keywords
from reporank.operators.jobs import top
from reporank.session import exists, written

BUCKETS = 64
TOP_SHARES = (0.001, 0.01, 0.1)  # of the repositories, by stars, that the first tiers hold
FILE_ROWS = 1_000_000  # postings a file holds, about
FIELDS = ("full_name", "description")


def words(*fields):
    """The different whole words of the fields."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0))


def _bucket(word, buckets):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _settings(spark, folder):
    schema = "buckets int, limits array<double>"
    return spark.read.schema(schema).parquet(f"{folder}/settings").first()


def append_words(repos: DataFrame, folder: str, key="full_name", stars="stars", fields=FIELDS):
    """Add the postings of further repositories; they are not looked for among stored ones."""
    set_ = _settings(repos.sparkSession, folder)
    # the first tier whose limit the stars reach; without stars the last one
    tier = F.lit(len(set_.limits))
    for i in reversed(range(len(set_.limits))):
        tier = F.when(F.col("stars") >= set_.limits[i], i).otherwise(tier)
    rows = repos.select(F.explode(words(*fields)).alias("word"), F.col(key).alias("key"), F.col(stars).cast("long").alias("stars"))
    rows = written(rows.withColumn("bucket", _bucket("word", set_.buckets)).withColumn("tier", tier.cast("int")))
    # a frequent word's directory is written by as many tasks as it has files
    counts = rows.groupBy("bucket", "tier").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    many = {(r.bucket, r.tier): r.files for r in counts.filter("files > 1").collect()}  # at most buckets x tiers rows
    files = F.lit(1)
    for (bucket, tier_), n in many.items():
        files = F.when((F.col("bucket") == bucket) & (F.col("tier") == tier_), n).otherwise(files)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, "bucket", "tier", F.pmod(F.xxhash64("key"), files))
    dealt = dealt.sortWithinPartitions("bucket", "tier", "word", F.desc("stars"))
    dealt.write.mode("append").partitionBy("bucket", "tier").parquet(f"{folder}/postings")


def build_word_index(repos: DataFrame, folder: str, buckets: int = BUCKETS, key="full_name", stars="stars", fields=FIELDS):
    """Store the postings of all repositories; a key occurs once."""
    shares = [1 - s for s in TOP_SHARES]
    limits = repos.agg(F.percentile_approx(F.col(stars).cast("double"), shares, 10_000)).first()[0] or []
    spark = repos.sparkSession
    settings = spark.createDataFrame([(buckets, [float(x) for x in limits])], "buckets int, limits array<double>")
    settings.coalesce(1).write.parquet(f"{folder}/settings")
    append_words(repos, folder, key, stars, fields)


def postings(spark, folder: str) -> DataFrame:
    """``(word, key, stars, bucket, tier)``; filters on the last two prune directories."""
    schema = "word string, key string, stars long, bucket int, tier int"
    if not exists(spark, f"{folder}/postings"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/postings")


def matching(spark, folder: str, asked: list[str], tier: int) -> DataFrame:
    """``(key, stars)`` of the repositories of one tier that hold all the words."""
    buckets = _settings(spark, folder).buckets
    numbers = spark.range(1).select(F.array(*(_bucket(F.lit(w), buckets) for w in asked))).first()[0]
    found = postings(spark, folder).filter(
        F.col("bucket").isin(sorted(set(numbers))) & (F.col("tier") == tier) & F.col("word").isin(asked)
    )
    if len(asked) == 1:
        return found.select("key", "stars")
    together = found.groupBy("key").agg(F.count("*").alias("n"), F.max("stars").alias("stars"))
    return together.filter(F.col("n") == len(asked)).select("key", "stars")


def search_words(
    repos: DataFrame, folder: str, query: str, n: int = fixed.CANDIDATES_FULL, key="full_name", stars="stars"
) -> DataFrame:
    """The most starred ``n`` of ``repos`` that hold every keyword of ``query`` as a whole word.

    ``repos`` is what was indexed; of it only the found rows are read, by a filter on the key.
    """
    spark = repos.sparkSession
    asked = spark.range(1).select(keywords(F.lit(query))).first()[0]
    asked, found = sorted(set(asked)), []
    tiers = len(_settings(spark, folder).limits) + 1
    for tier in range(tiers if asked and n > 0 else 0):
        best = top(matching(spark, folder, asked, tier), n - len(found), "stars", "key")
        found += [r.key for r in best.collect()]  # n rows at most in all
        if len(found) == n:
            break
    return top(repos.filter(F.col(key).isin(found)), n, stars, key)
