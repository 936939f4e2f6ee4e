"""Table functions for SQL: per-row mappers and per-group reducers of source code.

``register(spark)`` makes them known to SQL::

    SELECT f.repo, s.* FROM files f, LATERAL code_signatures(f.content, f.ext) s
    SELECT * FROM first_signatures(TABLE(lines) PARTITION BY repo ORDER BY (path, line_no))

Both are plain Python functions: Spark sends them rows in batches. As Arrow functions they would
give a record batch of its own for every input row, which costs far more than a line does.
Patterns are those of the column expressions in
:mod:`reporank.functions.code`.
"""

import re

from pyspark.sql.functions import udtf

from reporank import fixed

SIGNATURES = "line_no int, sig string, is_public boolean, is_error boolean"
FIRST = "repo {repo}, n int, sig string"

_PATTERNS = {
    ".py": (re.compile(fixed.PY_FUNCTION, re.A), re.compile(fixed.PY_ERROR)),
    ".go": (re.compile(fixed.GO_FUNCTION, re.A), re.compile(re.escape(fixed.GO_ERROR))),
    ".js": (re.compile(fixed.JS_FUNCTION, re.A), re.compile(fixed.JS_ERROR)),
    ".ts": (re.compile(fixed.JS_FUNCTION, re.A), re.compile(fixed.JS_ERROR)),
    ".java": (re.compile(fixed.JAVA_FUNCTION, re.A), None),
}


def read_line(line: str, ext: str):
    """(signature or None, is public, handles an error) of a trimmed line."""
    function, error = _PATTERNS.get(ext, (None, None))
    if function is None:
        return None, False, False
    found = function.search(line)
    name = next((g for g in found.groups() if g), None) if found else None
    public = name is not None and {".py": name[0] != "_", ".go": "A" <= name[0] <= "Z"}.get(ext, True)
    return name, public, bool(error and error.search(line))


class CodeSignatures:
    """One row for each line of a file: its number from 0, and what it declares or handles."""

    def eval(self, content: str, ext: str):
        if content:
            lines = content[: -1 if content.endswith("\n") else None].split("\n")
            for number, line in enumerate(lines):
                yield number, *read_line(line.strip(fixed.WHITESPACE), ext)


class FirstSignatures:
    """The first signatures of a partition, in its order, numbered from 1.

    A row has ``repo`` and ``sig``; rows without signature are passed over. Further rows of a
    partition that has its number are not looked at.
    """

    def __init__(self):
        self.n = 0

    def eval(self, row):
        if self.n < fixed.SIGNATURE_CAP and row["sig"] is not None:
            self.n += 1
            yield row["repo"], self.n, row["sig"]


def register(spark, repo: str = "string"):
    """Make the functions known to SQL; ``repo`` is the type of a repository's key."""
    functions = {
        "code_signatures": udtf(CodeSignatures, returnType=SIGNATURES, useArrow=False),
        "first_signatures": udtf(FirstSignatures, returnType=FIRST.format(repo=repo), useArrow=False),
    }
    for name, function in functions.items():
        spark.udtf.register(name, function)
