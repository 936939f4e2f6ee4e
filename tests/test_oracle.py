"""Every registered query against its SQL twin over the same tables."""

import os

import compare
import pytest

import __spark_entry__ as entry
from workload import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(queries.REGISTERED) == set(oracle.statements())
    assert set(queries.REGISTERED) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.REGISTERED))
def test_same_rows(spark, con, name):
    left = compare.spark_rows(queries.REGISTERED[name](spark, FOLDER))
    right = compare.sql_rows(con, oracle.statements()[name])
    assert not compare.differences(left, right)
    assert left[1], "no rows to compare"


def test_entry(spark):
    assert entry.entry(spark).count() == 20
