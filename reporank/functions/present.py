"""Text shown on the results page."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.numbers import fixed_text
from reporank.functions.text import _col


def shortened(text, limit: int = fixed.DESCRIPTION_LIMIT) -> Column:
    """Text cut to ``limit`` characters with an ellipsis; shorter text unchanged."""
    text = _col(text)
    head = F.rtrim(F.substring(text, 1, limit), F.lit(fixed.QUERY_WHITESPACE))
    return F.when(F.length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def percent(score) -> Column:
    """Whole percent, halves up."""
    return F.concat(F.floor(_col(score) * 100 + 0.5).cast("string"), F.lit("%"))


def score_class(score) -> Column:
    score = _col(score)
    return (
        F.when(score >= fixed.HIGH_SCORE, "high")
        .when(score >= fixed.MID_SCORE, "mid")
        .otherwise("low")
    )


def or_else(text, fallback: str) -> Column:
    """Text, or the fallback when it is null or empty."""
    return F.coalesce(F.nullif(_col(text), F.lit("")), F.lit(fallback))


def language_color(language) -> Column:
    pairs = [F.lit(x) for pair in fixed.LANGUAGE_COLORS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[_col(language)], F.lit(fixed.DEFAULT_COLOR))


def grouped_number(value) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(_col(value), 0)


def ratio_label(value, decimals: int) -> Column:
    """Ratio as a percent text with fixed decimals, null for null."""
    return F.concat(fixed_text(_col(value) * 100, decimals), F.lit("%"))


def days_label(days) -> Column:
    return F.concat(_col(days).cast("string"), F.lit(" days ago"))


def breakdown_labels(breakdown) -> Column:
    """Readable score breakdown; an entry is null when its input is."""
    b = _col(breakdown)
    return F.struct(
        ratio_label(b["test_file_ratio"], 1).alias("test_coverage_ratio"),
        ratio_label(b["error_handling_density"], 2).alias("error_handling_density"),
        b["public_api_count"].cast("string").alias("public_api_functions"),
        b["contributor_count"].cast("string").alias("contributors"),
        days_label(b["commit_recency_days"]).alias("last_commit"),
        ratio_label(b["issue_close_rate"], 0).alias("issue_close_rate"),
    )
