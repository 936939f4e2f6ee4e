"""Score formulas as column expressions; a missing input takes its default."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.numbers import round_even, round_up
from reporank.functions.text import _col


def _num(value, default=0.0) -> Column:
    return F.coalesce(_col(value).cast("double"), F.lit(float(default)))


def rounded(value) -> Column:
    return round_even(value, fixed.SCORE_DECIMALS)


def quality(test_ratio, error_density, api_norm) -> Column:
    errors = F.least(_num(error_density) / fixed.ERROR_CEILING, F.lit(1.0))
    return rounded(
        F.lit(fixed.TEST_WEIGHT) * _num(test_ratio)
        + F.lit(fixed.ERROR_WEIGHT) * errors
        + F.lit(fixed.API_WEIGHT) * _num(api_norm)
    )


def recency(days) -> Column:
    """1 for today, 0 from a year on; an unknown age counts as a year."""
    days = _num(days, fixed.MAX_DAYS)
    return F.when(days <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - days / fixed.MAX_DAYS))


def contributor_norm(count) -> Column:
    """Log scale, 1 from fifty contributors on."""
    ratio = F.log1p(_num(count)) / F.log1p(F.lit(float(fixed.MAX_CONTRIBUTORS)))
    return F.least(ratio, F.lit(1.0))


def health(days, contributors, close_rate) -> Column:
    return rounded(
        F.lit(fixed.RECENCY_WEIGHT) * recency(days)
        + F.lit(fixed.CONTRIBUTOR_WEIGHT) * contributor_norm(contributors)
        + F.lit(fixed.CLOSE_WEIGHT) * _num(close_rate)
    )


def weighted(relevance, quality_score, health_score) -> Column:
    """Weighted sum of the three scores, not rounded."""
    return (
        F.lit(fixed.RELEVANCE_WEIGHT) * _num(relevance)
        + F.lit(fixed.QUALITY_WEIGHT) * _num(quality_score)
        + F.lit(fixed.HEALTH_WEIGHT) * _num(health_score)
    )


def composite(relevance, quality_score, health_score) -> Column:
    return rounded(weighted(relevance, quality_score, health_score))


def breakdown(
    relevance="relevance_score",
    quality_score="quality_score",
    health_score="health_score",
    ast="ast",
    stats="contributor_stats",
) -> Column:
    """The nine raw inputs behind a composite score; every missing one is 0."""
    ast, stats = _col(ast), _col(stats)
    whole = lambda value: F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    return F.struct(
        _num(relevance).alias("relevance"),
        _num(quality_score).alias("quality"),
        _num(health_score).alias("health"),
        _num(ast["test_file_ratio"]).alias("test_file_ratio"),
        _num(ast["error_handling_density"]).alias("error_handling_density"),
        whole(ast["public_api_count"]).alias("public_api_count"),
        whole(stats["commit_recency"]).alias("commit_recency_days"),
        whole(stats["contributor_count"]).alias("contributor_count"),
        _num(stats["issue_close_rate"]).alias("issue_close_rate"),
    )


def lite_quality(description, stars, forks) -> Column:
    """Quality guessed from public metadata alone."""
    text = F.lower(F.coalesce(_col(description), F.lit("")))
    tests = F.when(text.contains("test"), fixed.LITE_TEST).otherwise(0.0)
    star = F.least(_num(stars) / fixed.LITE_STAR_CEILING, F.lit(1.0)) * fixed.LITE_STAR
    fork = F.least(_num(forks) / fixed.LITE_FORK_CEILING, F.lit(1.0)) * fixed.LITE_FORK
    return round_up(tests + star + fork, fixed.SCORE_DECIMALS)


def fractional_days(since, as_of) -> Column:
    micros = lambda ts: F.unix_micros(_col(ts).cast("timestamp"))
    return (micros(as_of) - micros(since)) / 86_400_000_000


def whole_days(since, as_of) -> Column:
    """Full days between two instants, cut towards zero."""
    return fractional_days(since, as_of).cast("long")


def lite_health(updated_at, open_issues, as_of) -> Column:
    """Health guessed from public metadata; a future update date may exceed 1."""
    fresh = F.greatest(F.lit(0.0), 1 - fractional_days(updated_at, as_of) / fixed.MAX_DAYS)
    issues = F.when(_num(open_issues) > 0, fixed.LITE_OPEN_ISSUES).otherwise(
        fixed.LITE_NO_OPEN_ISSUES
    )
    return round_up(
        F.lit(fixed.LITE_RECENCY) * fresh + F.lit(fixed.LITE_ISSUE) * issues, fixed.SCORE_DECIMALS
    )
