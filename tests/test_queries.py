"""Every registered query against its SQL, at the smallest scale."""

import pytest

from checks.compare import compare, duckdb_over
from checks.oracles import ORACLES
from checks.registry import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return duckdb_over(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, con, small, name):
    verdict = compare(spark, con, name, small)
    assert verdict.startswith("ok"), verdict


# The other join strategy: nothing fits a broadcast.
@pytest.mark.parametrize(
    "name", ["strip_comment_lines", "typed_edges", "end_to_end_lineage", "flatten_hierarchy"]
)
def test_same_rows_without_broadcast(spark, con, small, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        verdict = compare(spark, con, name, small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert verdict.startswith("ok"), verdict


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
