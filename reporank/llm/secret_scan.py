"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by pattern in whole texts. A candidate's value is hashed and counted
over the corpus: in how many repositories (documents, unless another column is named) and
of how many owners (`source`) it occurs. A value that several owners have is a widely
copied example; one that a single owner has in a few repositories, and that looks drawn at
random, is likely live. Base findings are reported whatever the counts say; besides them,
long tokens that look drawn at random are reported as `owned` or `copied`.

Positions are code points. Spark's functions give matches but no positions, so a text with
matches is also split at them; running sums over the lengths give the positions.

Defined cases: null text is empty text; a missing owner or repository counts as one owner
or repository of its own kind; repeated rows get the same answer; other columns are
ignored; an empty table gives an empty result.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reporank.session import written

# What counts as a candidate, and the length its value needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same as runs of any length without the short ones
LONG = r"[A-Za-z0-9+/_-]{20,}"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24), ("long", LONG, 20))
ORDER = ("assign", "access", "hex", "owned", "copied")

OWNED_REPOS = 8  # a value in more repositories of its only owner is taken for a copied example


def _found(text):
    """Matches of each kind, and the lengths of what lies before each of them.

    A pattern is only tried on texts that hold a string every match of it holds.
    """
    none, low = F.array().cast("array<string>"), F.lower(text)
    may = {
        "assign": reduce(or_, [low.contains(word) for word in ("password", "passwd", "secret", "token", "api")]),
        "access": text.contains("AKIA"),
        "hex": F.lit(True),
        "long": text.rlike("[0-9]"),  # without a digit no token looks drawn at random
    }
    columns = []
    for kind, pattern, _ in KINDS:
        hits = F.when(may[kind], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        lengths = F.transform(F.split(text, pattern, -1), F.char_length)
        columns.append(F.struct(F.lit(kind).alias("kind"), hits.alias("hits"), F.when(F.size(hits) > 0, lengths).alias("gaps")))
    return F.filter(F.array(*columns), lambda x: F.size(x["hits"]) > 0)


def _spans(rows):
    """One row per match: its span, its value, and whether the value is long enough."""
    by_kind = rows.select("row", "repo", "owner", F.explode("found").alias("f"))
    hits = by_kind.select(
        "row", "repo", "owner", "f.kind", F.posexplode(F.arrays_zip("f.hits", "f.gaps")).alias("at", "hit")
    ).filter("hit.hits IS NOT NULL")
    length = F.char_length("hit.hits")
    until = F.sum(F.col("hit.gaps") + length).over(Window.partitionBy("row", "kind").orderBy("at"))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("hit.hits", ASSIGN, 2)).otherwise(F.col("hit.hits"))
    spans = hits.select("row", "repo", "owner", "kind", (until - length).alias("start"), until.alias("end"), value.alias("value"))
    least = F.create_map(*(F.lit(x) for kind, _, n in KINDS for x in (kind, n)))
    kept = (F.col("kind") != "long") | _random_looking(F.col("value"))
    return spans.filter(kept & (F.char_length("value") >= least[F.col("kind")]))


def _random_looking(value):
    """Letters and digits mixed, and at least ten different characters."""
    different = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 10)


def ownership(spans: DataFrame) -> DataFrame:
    """Per value digest: distinct repositories and owners, and the verdict.

    Occurrences are reduced to one row per value, owner and repository before they meet.
    """
    single = spans.groupBy("digest", "owner", "repo").agg(F.max("random").alias("random"))
    owners = single.groupBy("digest", "owner").agg(F.max("random").alias("random"))
    owners = owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.max("random").alias("random"))
    repos = single.select("digest", "repo").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_repos"))
    copied = (F.col("n_owners") > 1) | (F.col("n_repos") > OWNED_REPOS)
    verdict = F.when(copied, "copied").when(F.col("random"), "owned").otherwise("unclear")
    return owners.join(repos, "digest").select("digest", "n_repos", "n_owners", verdict.alias("verdict"))


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    repo_column: str | None = None,
) -> DataFrame:
    """Per document: doc_id and `spans`, an array sorted by start, then kind.

    A span has start, rank (place of its kind in ORDER), kind, end, digest, n_repos,
    n_owners and verdict.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(
        F.col(id_column).alias("id"),
        F.col(owner_column).alias("owner"),
        F.col(repo_column or id_column).alias("repo"),
        text.alias("text"),
    )
    rows = read.select("id", "owner", "repo", F.monotonically_increasing_id().alias("row"), _found(F.col("text")).alias("found"))
    rows = written(rows)  # the row numbers are what they are from here on
    spans = _spans(rows).select("*", F.unhex(F.sha2("value", 256)).alias("digest"), _random_looking(F.col("value")).alias("random"))
    spans = written(spans.drop("value"))
    # written, so that the join can split a value that very many texts have
    judged = spans.join(written(ownership(spans)), "digest")
    kind = F.when(F.col("kind") == "long", F.col("verdict")).otherwise(F.col("kind"))
    judged = judged.withColumn("kind", kind).filter("kind <> 'unclear'")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "kind", "end", "digest", "n_repos", "n_owners", "verdict")
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    all_rows = rows.select("row", "id").join(by_row, "row", "left")
    return all_rows.select(F.col("id").alias(id_column), F.coalesce("spans", F.from_json(F.lit("[]"), by_row.schema["spans"].dataType)).alias("spans"))


def listed(spans, *more):
    """kind:start:end of an array of spans (and more fields of them), comma-joined."""
    fields = ("kind", "start", "end", *more)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[f] for f in fields))), ",")


def base_only(spans):
    return F.filter(spans, lambda s: s["rank"] <= 3)


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def judged(spans, verdict):
    """How many of the spans have the verdict."""
    return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long")
