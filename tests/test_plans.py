"""What the plans must look like to hold at scale."""

import ast
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from reporank.operators import jobs as J
from reporank.operators.dedup import band_winners
from reporank.operators.metrics import annotate_lines, signature_rows
from reporank.operators.normalize import minmax_normalize
from reporank.plans import ranking as R
from workload import queries as Q
from workload import views as W

FOLDER = "/root/testdata/sf0.001"
PACKAGE = pathlib.Path(__file__).parent.parent / "reporank"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_is_cut_in_every_task(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    assert "TakeOrderedAndProject" in plan(J.top(df, 5, "id", "id"))
    assert "WindowGroupLimit [g" in plan(J.top(df, 5, "id", "id", by="g")).replace("#", " ").replace(
        "[g ", "[g")


def test_signatures_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([], "repo string, path string, line_no int, line string")
    text = plan(signature_rows(annotate_lines(df)))
    limits = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    assert len(limits) == 2 and limits[0] < text.index("Exchange") < limits[1]


def test_bounds_are_a_subquery_not_a_cross_join(spark):
    text = plan(minmax_normalize(W.records(W.repos(spark, FOLDER))))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Subquery" in text


@pytest.mark.parametrize("name", ["rank_repos_any_band", "rank_jobs", "search_split",
                                  "semantic_cache", "duplicate_links"])
def test_no_cross_joins(spark, name):
    text = plan(Q.REGISTERED[name](spark, FOLDER))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_buckets_are_aggregated_before_the_shuffle(spark):
    text = plan(band_winners(W.landed_fingerprints(spark, FOLDER), "doc_id"))
    assert "Window" not in text and text.count("partial_min(no") == 1
    assert "SortAggregate" not in text  # the sixteen band rows are not sorted


def test_inputs_are_read_once(spark):
    """File scans, however often a lookup is joined."""
    by_job = plan(Q.minmax_by_job(spark, FOLDER))
    assert by_job.count("FileScan") <= 6 and by_job.count("lineitem") <= 2
    assert plan(Q.rank_jobs(spark, FOLDER)).count("FileScan") <= 15


def test_scans_read_only_what_is_used(spark):
    scan = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(J.latest_status(W.job_events(spark, FOLDER)))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type" in text
    assert "props" not in text and scan.columns
    text = plan(J.job_status(W.job_events(spark, FOLDER), 7))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in text


def test_similarity_is_computed_once_per_row(spark):
    scored = R.with_relevance(W.stored_queries(spark, FOLDER), W.query_vector(spark, FOLDER))
    assert plan(scored).count("similarity(") == 1


def test_library_collects_only_bounded_rows():
    """Collecting calls of the library, each with the bound that makes it safe."""
    allowed = {
        "components.py": {"first"},  # one row of totals per round
        "nearest.py": {"first", "collect", "toArrow"},  # one row, a row per pivot, a checked limit
        "vector_index.py": {"collect", "toArrow"},  # a row per cell, the training sample
        "dedup_store.py": {"collect"},  # a row per batch
        "metrics_store.py": {"collect"},  # a row per version
        "word_index.py": {"first", "collect"},  # one row, a row per directory, n results
        "keyed.py": {"collect"},  # a row per bucket, a checked number of keys
        "tree.py": {"first"},  # one row of totals
    }
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":  # tested on its own
            continue
        calls = {
            node.func.attr
            for node in ast.walk(ast.parse(path.read_text()))
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)
        }
        eager = calls & {"collect", "toPandas", "toArrow", "take", "first", "head",
                         "toLocalIterator", "localCheckpoint", "crossJoin", "cache", "persist"}
        functions = ("dedup.py", "dedup_store.py", "metrics_store.py", "set_join.py")  # F.first
        eager -= {**dict.fromkeys(functions, {"first"}), "minhash.py": {"take"}}.get(path.name, set())  # not actions
        assert eager <= allowed.get(path.name, set()), path
