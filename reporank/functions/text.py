"""String expressions: tokens, keywords, embedding text, paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reporank import fixed


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def _char_class(chars):
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


SPACE_CLASS = _char_class(fixed.WHITESPACE)
QUERY_SPACE_CLASS = _char_class(fixed.QUERY_WHITESPACE)


def trimmed(text) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.btrim(_col(text), F.lit(fixed.WHITESPACE))


def tokens(text) -> Column:
    """White-space separated tokens, in order, without empty ones."""
    parts = F.split(_col(text), SPACE_CLASS + "+")
    return F.filter(parts, lambda t: t != "")


def keywords(text) -> Column:
    """Up to five search keywords: lower case, a-z0-9 only, long enough, no stop words."""
    kept = F.regexp_replace(
        F.lower(_col(text)), "[^a-z0-9" + QUERY_SPACE_CLASS[1:-1] + "]", ""
    )
    words = F.filter(
        F.split(kept, QUERY_SPACE_CLASS + "+"),
        lambda w: (F.length(w) >= fixed.KEYWORD_MIN_LENGTH) & ~w.isin(*fixed.STOP_WORDS),
    )
    return F.slice(words, 1, fixed.KEYWORD_CAP)


def search_query(text) -> Column:
    """Keywords joined by ``+``."""
    return F.array_join(keywords(text), "+")


def encoded_query(text) -> Column:
    """Query text, URL-encoded: blanks as ``+``, letters, digits and ``-_.~`` as they are."""
    return F.replace(
        F.replace(F.url_encode(_col(text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def is_blank(text) -> Column:
    """True for null, empty and white-space-only text."""
    value = F.btrim(F.coalesce(_col(text), F.lit("")), F.lit(fixed.QUERY_WHITESPACE))
    return value == ""


def embedding_text(description, parts, limit=fixed.SIGNATURES_IN_TEXT) -> Column:
    """Description followed by the first ``limit`` parts (all when None), space-joined."""
    extra = F.coalesce(_col(parts), F.array().cast("array<string>"))
    if limit is not None:
        extra = F.slice(extra, 1, limit)
    head = F.array(F.coalesce(_col(description), F.lit("")))
    return F.array_join(F.concat(head, extra), " ")


def extension(path) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]*)$", 1))


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_dir(path) -> Column:
    """Everything before the last slash; ``/`` when there is no slash."""
    path = _col(path)
    return F.when(F.instr(path, "/") == 0, "/").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def sanitize(name) -> Column:
    """Name usable as a folder name."""
    return F.translate(_col(name), "/", "_")


def job_path(root, *parts) -> Column:
    """Slash-joined path below ``root``."""
    return F.concat_ws("/", F.lit(root), *[_col(p) for p in parts])
