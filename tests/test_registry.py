"""Every registered query against its check SQL on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], FOLDER) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).collect()


def test_entry(spark):
    assert registry.entry(spark).columns == ["group", "n", "mean", "sd"]
