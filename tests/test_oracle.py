"""Every registered query with a SQL twin against DuckDB, over the whole smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TWINS = contract.oracle_sql()
# Queries that look for faults which the tables don't have.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_rows_as_sql(spark, con, name):
    result = compare(contract.queries()[name](spark, SF_DIR), con, TWINS[name])
    assert result.startswith(("ok", "EMPTY") if name in MAY_BE_EMPTY else "ok"), result


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(TWINS)))
def test_runs_without_sql(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["analogues", "multi_hot", "clique_edges2", "cloud_pool", "stratified_split", "sessionize_lines"])
def test_same_answer_with_one_shuffle_partition(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        result = compare(contract.queries()[name](spark, SF_DIR), con, TWINS[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert result.startswith("ok"), result
