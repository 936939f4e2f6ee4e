"""One declared schema per stage: nothing is inferred from the data."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_STR, _INT, _NUM, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
VECTOR = T.ArrayType(T.DoubleType())
FINGERPRINT = T.ArrayType(T.LongType())  # unsigned 32-bit minima do not fit INT

AST = _struct(
    ("function_signatures", T.ArrayType(_STR)),
    ("public_api_count", _INT),
    ("test_file_ratio", _NUM),
    ("error_handling_density", _NUM),
    ("minhash_fingerprint", FINGERPRINT),
    ("total_files", _INT),
    ("total_lines", _INT),
    ("language", _STR),
)

CONTRIBUTOR_STATS = _struct(
    ("contributor_count", _INT), ("commit_recency", _INT), ("issue_close_rate", _NUM)
)

REPO = _struct(
    ("full_name", _STR),
    ("url", _STR),
    ("description", _STR),
    ("language", _STR),
    ("stars", _INT),
    ("forks", _INT),
    ("ast", AST),
    ("contributor_stats", CONTRIBUTOR_STATS),
)

# Crawl files spell the contributor fields in CamelCase, later stages in snake_case.
RAW_CONTRIBUTOR_STATS = T.StructType(
    CONTRIBUTOR_STATS.fields
    + _struct(
        ("ContributorCount", _INT), ("CommitRecency", _INT), ("IssueCloseRate", _NUM)
    ).fields
)

SEARCH_ITEM = _struct(
    ("full_name", _STR),
    ("html_url", _STR),
    ("clone_url", _STR),
    ("description", _STR),
    ("language", _STR),
    ("stargazers_count", _INT),
    ("forks_count", _INT),
    ("open_issues_count", _INT),
    ("topics", T.ArrayType(_STR)),
    ("updated_at", _TS),
)

BREAKDOWN = _struct(
    ("relevance", _NUM),
    ("quality", _NUM),
    ("health", _NUM),
    ("test_file_ratio", _NUM),
    ("error_handling_density", _NUM),
    ("public_api_count", _INT),
    ("commit_recency_days", _INT),
    ("contributor_count", _INT),
    ("issue_close_rate", _NUM),
    ("stars", _INT),
)

SOURCE_FILE = _struct(("repo", _STR), ("path", _STR), ("content", _STR))

QUERIES = _struct(
    ("id", _STR), ("text", _STR), ("embedding", VECTOR), ("job_id", _STR), ("created_at", _TS)
)

RESULTS = _struct(
    ("id", _STR),
    ("job_id", _STR),
    ("repo_full_name", _STR),
    ("repo_url", _STR),
    ("description", _STR),
    ("language", _STR),
    ("stars", _INT),
    ("relevance_score", _NUM),
    ("quality_score", _NUM),
    ("health_score", _NUM),
    ("composite_score", _NUM),
    ("score_breakdown", _STR),
    ("created_at", _TS),
)

JOB_EVENTS = _struct(
    ("job_id", _STR), ("status", _STR), ("query", _STR), ("updated_at", _TS), ("seq", _INT)
)
