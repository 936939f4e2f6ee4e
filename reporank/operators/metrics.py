"""Code metrics of a repository from its source lines."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions import code as C
from reporank.functions.minhash import minhash_by, text_or_minhash
from reporank.functions.text import extension, trimmed
from reporank.schemas import FINGERPRINT
from reporank.session import written
from reporank.sources.raw import content_lines


def annotate_lines(lines: DataFrame) -> DataFrame:
    """Lines ``(repo, path, line_no, line)`` with what each one contributes.

    A null ``line`` stands for an empty file: it counts as a file, not as a line.
    """
    ext = extension("path")
    staged = (
        lines.withColumns({"ext": ext, "line": trimmed("line")})
        .withColumn("sig", C.signature("line", "ext"))
        .withColumn("sig", F.when(F.col("sig") != "", F.col("sig")))
    )
    return staged.withColumns(
        {
            "is_public": F.coalesce(C.is_public("sig", "ext"), F.lit(False)),
            "is_error": F.coalesce(C.handles_error("line", "ext"), F.lit(False)),
        }
    )


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def file_counts(annotated: DataFrame) -> DataFrame:
    """One row per file. Grouping by file first spreads a repo over many tasks."""
    return annotated.groupBy("repo", "path", "ext").agg(
        F.count("line").alias("lines"),
        F.count_if("is_error").alias("error_lines"),
        F.count_if("is_public").alias("public"),
    )


def repo_counts(files: DataFrame) -> DataFrame:
    """Sums and ratios per repo over its supported files; 0 where it has none."""
    source = C.is_source("ext")
    totals = files.groupBy("repo").agg(
        F.count_if(source).alias("total_files"),
        F.count_if(source & C.is_test_file("path")).alias("test_files"),
        F.coalesce(F.sum(F.when(source, F.col("lines"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(source, F.col("error_lines"))), F.lit(0)).alias("error_lines"),
        F.coalesce(F.sum(F.when(source, F.col("public"))), F.lit(0)).alias("public_api_count"),
    )
    return totals.select(
        "repo",
        "public_api_count",
        _ratio(F.col("test_files"), F.col("total_files")).alias("test_file_ratio"),
        _ratio(F.col("error_lines"), F.col("total_lines")).alias("error_handling_density"),
        "total_files",
        "total_lines",
    )


def dominant_language(files: DataFrame) -> DataFrame:
    """Language with most files per repo, ties by name, empty without supported files."""
    counted = files.groupBy("repo", C.language_of("ext").alias("language")).agg(
        F.count("*").alias("files")
    )
    best = F.min(
        F.when(F.col("language").isNotNull(), F.struct(-F.col("files"), F.col("language")))
    )
    return (
        counted.groupBy("repo")
        .agg(best.alias("best"))
        .select("repo", F.coalesce("best.language", F.lit("")).alias("language"))
    )


def signature_rows(annotated: DataFrame, cap: int = fixed.SIGNATURE_CAP) -> DataFrame:
    """First ``cap`` signatures per repo, in folder walk order, then line order.

    Spark applies the rank limit within each task before the shuffle, so a huge
    repo never meets in one place. Comparing path parts, not path text, puts a
    folder before a file whose name starts with the folder's.
    """
    order = Window.partitionBy("repo").orderBy(F.split("path", "/"), "line_no", "sig")
    return (
        annotated.filter(F.col("sig").isNotNull())
        .select("repo", "path", "line_no", "sig", F.row_number().over(order).alias("n"))
        .filter(F.col("n") <= cap)
    )


def signatures(rows: DataFrame) -> DataFrame:
    """``(repo, function_signatures)`` from the rows of :func:`signature_rows`."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "sig")))
    return rows.groupBy("repo").agg(
        F.transform(ordered, lambda x: x["sig"]).alias("function_signatures")
    )


def _record(counts, language, names, prints):
    """The four parts as one ``(repo, ast)``; absent parts take their empty value."""
    empty = F.array_repeat(F.lit(fixed.EMPTY_MINIMUM), fixed.NUM_HASHES).cast(FINGERPRINT)
    joined = counts.join(language, "repo").join(names, "repo", "left").join(prints, "repo", "left")
    return joined.select(
        "repo",
        F.struct(
            "function_signatures",
            "public_api_count",
            "test_file_ratio",
            "error_handling_density",
            F.coalesce("minhash_fingerprint", empty).alias("minhash_fingerprint"),
            "total_files",
            "total_lines",
            "language",
        ).alias("ast"),
    )


def code_metrics(lines: DataFrame) -> DataFrame:
    """``(repo, ast)`` from a table of ``(repo, path, line_no, line)``.

    A repo without supported files keeps zeros, an empty language and a
    fingerprint of 128 empty minima.
    """
    annotated = annotate_lines(lines)
    files = file_counts(annotated)
    prints = minhash_by(annotated.filter(C.is_source("ext")), "repo", "line")
    return _record(
        repo_counts(files), dominant_language(files), signatures(signature_rows(annotated)), prints
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """What each ``(repo, path, content)`` contributes, in one pass without a shuffle.

    A content that is shorter than a fingerprint stays as ``text``; others have theirs as ``fp``.
    """
    text, fp = text_or_minhash("content")
    source = files.withColumn("ext", extension("path")).select(
        "repo", "path", "ext", F.when(C.is_source("ext"), F.col("content")).alias("content")
    )
    lines = F.transform(content_lines(F.col("content")), trimmed)
    ext = F.col("ext")
    found = F.filter(
        F.transform("text", lambda line: C.signature(line, ext)), lambda sig: sig != ""
    )
    errors = F.filter("text", lambda line: C.handles_error(line, ext))
    public = F.filter("sigs", lambda sig: C.is_public(sig, ext))
    read = source.withColumn(
        "text", F.coalesce(lines, F.array().cast("array<string>"))
    ).withColumn("sigs", found)
    return read.select(
        "repo",
        "path",
        "ext",
        F.size("text").cast("long").alias("lines"),
        F.size(errors).cast("long").alias("error_lines"),
        F.size(public).cast("long").alias("public"),
        F.slice("sigs", 1, fixed.SIGNATURE_CAP).alias("sigs"),
        text.alias("text"),
        fp.alias("fp"),
    )


def analyze_files(files: DataFrame) -> DataFrame:
    """``(repo, ast)`` from whole files, each read once.

    The per-file summary is written to the shared folder; the repo totals are
    then small aggregates over it.
    """
    summary = written(file_metrics(files))
    named = summary.select("repo", "path", F.posexplode("sigs").alias("line_no", "sig"))
    prints = minhash_by(summary.filter(C.is_source("ext")), "repo", "text", "fp")
    return _record(
        repo_counts(summary),
        dominant_language(summary),
        signatures(signature_rows(named)),
        prints,
    )
