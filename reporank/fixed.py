"""The results depend on each of them being exactly this."""

# Score weights and ceilings.
RELEVANCE_WEIGHT, QUALITY_WEIGHT, HEALTH_WEIGHT = 0.50, 0.30, 0.20
TEST_WEIGHT, ERROR_WEIGHT, API_WEIGHT = 0.40, 0.35, 0.25
RECENCY_WEIGHT, CONTRIBUTOR_WEIGHT, CLOSE_WEIGHT = 0.40, 0.35, 0.25
ERROR_CEILING = 0.10
MAX_DAYS = 365
MAX_CONTRIBUTORS = 50
SCORE_DECIMALS = 4

# Metadata-only ("lite") scores.
LITE_TEST, LITE_STAR, LITE_FORK = 0.3, 0.4, 0.3
LITE_STAR_CEILING, LITE_FORK_CEILING = 5000, 1000
LITE_RECENCY, LITE_ISSUE = 0.6, 0.4
LITE_OPEN_ISSUES, LITE_NO_OPEN_ISSUES = 0.5, 0.3
LITE_DEFAULT_RELEVANCE = 0.5

# Result sizes, similarity cut-off, caps that are features.
TOP_FULL, TOP_LITE, TOP_READ = 20, 10, 10
CANDIDATES_FULL, CANDIDATES_LITE = 40, 20
CACHE_SIMILARITY = 0.92
SIGNATURE_CAP = 50
SIGNATURES_IN_TEXT = 10
KEYWORD_CAP = 5
KEYWORD_MIN_LENGTH = 3

# MinHash and LSH banding.
NUM_HASHES, NUM_BANDS, BAND_ROWS = 128, 16, 8
EMPTY_MINIMUM = 0xFFFFFFFF

# Embedding width and batch size.
EMBEDDING_DIMS = 384
EMBEDDING_BATCH = 32

# Features that are min-max normalized.
FEATURES = ("test_file_ratio", "error_handling_density", "public_api_count", "total_lines")

# Job states.
JOB_STATES = ("pending", "running", "done", "failed")

# Words that never become search keywords.
STOP_WORDS = (
    "a", "an", "the", "for", "with", "and", "or", "of", "to", "in", "on", "at", "by",
    "i", "need", "want", "looking", "find", "get", "some", "good", "best", "using",
    "that", "has", "have", "can", "is", "are", "my", "me", "please", "library", "tool",
)

# File extension to language.
LANGUAGES = {
    ".py": "Python", ".go": "Go", ".js": "JavaScript", ".ts": "JavaScript", ".java": "Java",
}

# Line patterns, written for both java.util.regex and RE2.
# [\t\n\f\r ] is what \s means in RE2; Java's has the vertical tab too.
PY_FUNCTION = r"^def[\t\n\f\r ]+([a-zA-Z_]\w*)[\t\n\f\r ]*\("
GO_FUNCTION = r"^func[\t\n\f\r ]+(\w+)[\t\n\f\r ]*\("
JS_FUNCTION = (
    r"(?:function[\t\n\f\r ]+(\w+)"
    r"|const[\t\n\f\r ]+(\w+)[\t\n\f\r ]*=[\t\n\f\r ]*(?:async[\t\n\f\r ]*)?\()"
)
JAVA_FUNCTION = (
    r"(?:public|protected)[\t\n\f\r ]+\w+[\t\n\f\r ]+(\w+)[\t\n\f\r ]*\("
)
GO_ERROR = "if err != nil"
PY_ERROR = r"except[\t\n\f\r ]+"
JS_ERROR = r"catch[\t\n\f\r ]*\("

# Language badge colours of the results page.
LANGUAGE_COLORS = {
    "Python": "#3572A5", "TypeScript": "#2b7489", "JavaScript": "#f1e05a",
    "Go": "#00ADD8", "Java": "#b07219", "Rust": "#dea584", "Ruby": "#701516",
    "C++": "#f34b7d", "C": "#555555", "Swift": "#F05138",
}
DEFAULT_COLOR = "#6b7280"

# Presentation cut-offs and fallbacks.
DESCRIPTION_LIMIT = 160
HIGH_SCORE, MID_SCORE = 0.7, 0.4
NO_LANGUAGE = "Unknown"
NO_DESCRIPTION = "No description provided."

# Unicode White_Space, the separators between source tokens.
WHITESPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
# The separators of free-text queries (no next-line, but the byte-order mark).
QUERY_WHITESPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)))
