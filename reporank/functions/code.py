"""Expressions over one source line or one file path."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reporank import fixed
from reporank.functions.text import _col, basename

JS_EXTENSIONS = (".js", ".ts")


def is_source(ext) -> Column:
    """True for the extensions that are analysed."""
    return _col(ext).isin(*fixed.LANGUAGES)


def language_of(ext) -> Column:
    """Language of a lower-case extension, null for others."""
    pairs = [F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair]
    return F.create_map(*pairs)[_col(ext)]


def is_test_file(path) -> Column:
    name = F.lower(basename(path))
    return name.contains("test") | name.endswith(".spec.ts")


def _has(line, *words):
    """Cheap test that spares most lines the regular expression."""
    found = [line.contains(word) for word in words]
    return reduce(lambda a, b: a | b, found)


def signature(line, ext) -> Column:
    """Name of the function declared on a trimmed line, empty when there is none."""
    line, ext = _col(line), _col(ext)

    def group(pattern, n=1):
        return F.regexp_extract(line, pattern, n)

    return (
        F.when((ext == ".py") & line.startswith("def"), group(fixed.PY_FUNCTION))
        .when((ext == ".go") & line.startswith("func"), group(fixed.GO_FUNCTION))
        .when(
            ext.isin(*JS_EXTENSIONS) & _has(line, "function", "const"),
            F.concat(group(fixed.JS_FUNCTION, 1), group(fixed.JS_FUNCTION, 2)),
        )
        .when((ext == ".java") & _has(line, "public", "protected"), group(fixed.JAVA_FUNCTION))
        .otherwise("")
    )


def is_public(sig, ext) -> Column:
    """Whether a signature is public API; the Java pattern only matches public ones."""
    sig, ext = _col(sig), _col(ext)
    return (
        F.when(ext == ".py", (sig != "") & ~sig.startswith("_"))
        .when(ext == ".go", sig.rlike("^[A-Z]"))
        .otherwise(sig != "")
    )


def handles_error(line, ext) -> Column:
    """Whether a line handles an error (never counted for Java)."""
    line, ext = _col(line), _col(ext)
    return (
        F.when(ext == ".go", line.contains(fixed.GO_ERROR))
        .when(ext == ".py", _has(line, "except") & line.rlike(fixed.PY_ERROR))
        .when(ext.isin(*JS_EXTENSIONS), _has(line, "catch") & line.rlike(fixed.JS_ERROR))
        .otherwise(False)
    )
