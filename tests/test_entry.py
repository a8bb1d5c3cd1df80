"""The registered queries and their SQL."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "debt" in out.columns
