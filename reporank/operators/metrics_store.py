"""Code metrics that follow a changing tree: only changed files are analysed.

A folder keeps, for every version of the trees:

* ``files``: ``(repo, path, ext, digest, gone)`` of the files that changed, ``gone`` where one
  was deleted; the state of a file is its last version;
* ``summaries``: what a content contributes, by digest and extension, once for ever: a file
  that was moved or copied, or comes back, is not analysed again. Its part in a fingerprint is
  the ``text`` where that is shorter, else ``fp``; earlier stores have ``fp`` only;
* ``metrics``: ``(repo, ast)`` of the repositories that the version touched; ``ast`` is null
  where no file is left.

Totals of a touched repository are taken over its stored summaries, never adjusted: a minimum
of a fingerprint cannot be taken back. A version becomes visible by a marker that is written
last. One writer at a time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.functions import code as C
from reporank.functions.minhash import minhash_by
from reporank.functions.text import extension
from reporank.operators.metrics import _record, dominant_language, file_metrics, repo_counts, signature_rows, signatures
from reporank.session import dropped, exists, written

VERSION = "version long"
SUMMARY = (
    "digest string, ext string, lines long, error_lines long, public long, sigs array<string>, "
    "text string, fp array<bigint>, version long"
)


def _versions(spark, folder):
    if not exists(spark, f"{folder}/finished"):
        return []
    rows = spark.read.schema(VERSION).parquet(f"{folder}/finished").collect()  # one row per version
    return sorted(r.version for r in rows)


def _read(spark, folder, name, versions, schema=None):
    paths = [f"{folder}/{name}/version={v}" for v in versions]
    reader = spark.read.option("basePath", f"{folder}/{name}")
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def _digests(files):
    """``(repo, path, ext, digest, content)``; contents that no metric reads have no digest."""
    ext = extension("path")
    digest = F.when(C.is_source(ext) & F.col("content").isNotNull(), F.sha2("content", 256))
    return files.select("repo", "path", ext.alias("ext"), F.coalesce(digest, F.lit("")).alias("digest"), "content")


def current_files(spark, folder: str, before: int | None = None) -> DataFrame:
    """``(repo, path, ext, digest)`` of all files there are, as of the last version."""
    versions = [v for v in _versions(spark, folder) if before is None or v < before]
    state = _read(spark, folder, "files", versions)
    last = F.max_by(F.struct("ext", "digest", "gone"), "version").alias("last")
    return state.groupBy("repo", "path").agg(last).select("repo", "path", "last.*").filter("NOT gone").drop("gone")


def update_metrics(changed: DataFrame, folder: str, deleted: DataFrame | None = None) -> int:
    """Take in files ``(repo, path, content)`` that are new or may have changed, and deletions.

    ``deleted`` has ``(repo, path)``. A file that is sent unchanged costs its digest only. A
    file both changed and deleted is deleted. Returns the version's number.
    """
    spark = changed.sparkSession
    versions = _versions(spark, folder)
    version = versions[-1] + 1 if versions else 1
    for name in ("files", "summaries", "metrics"):
        if exists(spark, f"{folder}/{name}/version={version}"):
            dropped(spark, f"{folder}/{name}/version={version}")  # left by an interrupted run

    def landed(df, name):
        df.write.parquet(f"{folder}/{name}/version={version}")

    sent = _digests(changed.select("repo", "path", "content"))
    slim = written(sent.drop("content").withColumn("gone", F.lit(False)))
    if deleted is not None:
        away = deleted.select("repo", "path").distinct()
        removed = away.select("repo", "path", extension("path").alias("ext"), F.lit("").alias("digest"), F.lit(True).alias("gone"))
        slim = slim.join(away, ["repo", "path"], "left_anti").unionByName(removed)
    if versions:
        known = current_files(spark, folder).select("repo", "path", F.col("digest").alias("was"))
        slim = slim.join(known, ["repo", "path"], "left")
        same = F.col("was").isNotNull() & ~F.col("gone") & (F.col("was") == F.col("digest"))
        slim = slim.filter(~same & ~(F.col("gone") & F.col("was").isNull())).drop("was")
    else:
        slim = slim.filter("NOT gone")
    slim = written(slim.select("repo", "path", "ext", "digest", "gone"))
    landed(slim, "files")
    # contents that nobody has analysed yet; of equal ones, one
    fresh = slim.filter("NOT gone AND digest <> ''").select("digest", "ext").distinct()
    if versions:
        known = _read(spark, folder, "summaries", versions, SUMMARY).select("digest", "ext")
        fresh = fresh.join(known, ["digest", "ext"], "left_anti")
    one = sent.join(written(fresh), ["digest", "ext"]).groupBy("digest", "ext").agg(F.first("content").alias("content"))
    summary = file_metrics(one.select(F.col("digest").alias("repo"), F.concat(F.lit("x"), "ext").alias("path"), "content"))
    landed(summary.withColumnRenamed("repo", "digest").drop("path"), "summaries")
    # touched repositories, anew from the summaries of all their files
    now = [*versions, version]
    state = _read(spark, folder, "files", now)
    touched = written(slim.select("repo").distinct())
    last = F.max_by(F.struct("ext", "digest", "gone"), "version").alias("last")
    tree = state.join(touched, "repo", "left_semi").groupBy("repo", "path").agg(last)
    tree = written(tree.select("repo", "path", "last.*").filter("NOT gone").drop("gone"))
    summaries = _read(spark, folder, "summaries", now, SUMMARY).drop("version")
    landed(touched.join(_totals(tree, summaries), "repo", "left"), "metrics")
    mark = spark.createDataFrame([(version,)], VERSION).coalesce(1)
    mark.write.mode("append").parquet(f"{folder}/finished")
    return version


def _totals(tree, summaries):
    """``(repo, ast)`` of the files of a tree from the summaries of their contents."""
    counts = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("lines", "error_lines", "public")}
    rows = tree.join(summaries, ["digest", "ext"], "left")
    rows = written(rows.select("repo", "path", "ext", *counts.values(), "sigs", "text", "fp"))
    named = rows.select("repo", "path", F.posexplode("sigs").alias("line_no", "sig"))
    prints = minhash_by(rows.filter(C.is_source("ext")), "repo", "text", "fp")
    return _record(repo_counts(rows), dominant_language(rows), signatures(signature_rows(named)), prints)


def stored_metrics(spark, folder: str) -> DataFrame:
    """``(repo, ast)`` of every repository that has files, as of the last version."""
    metrics = _read(spark, folder, "metrics", _versions(spark, folder))
    last = metrics.groupBy("repo").agg(F.max_by("ast", "version").alias("ast"))
    return last.filter("ast IS NOT NULL")
