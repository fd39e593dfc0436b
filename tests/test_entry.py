"""The driver's three functions."""

import os

import pytest

import __spark_entry__ as driver


def test_oracles_are_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["metric", "source", "tags", "bin_start_ms", "mean", "count"] and df.count() > 0
