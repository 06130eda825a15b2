"""Catalog rules and table types."""

import pytest

from tablewake.functions.names import normalise_case, qualify
from tablewake.operators import catalog as C
from pyspark.sql import functions as F

from .conftest import rows


@pytest.fixture
def types(spark):
    data = [("  a.x ", "V", 1), ("A.X", "T ", 2), ("a.y", "V", 3), ("a.z", "O", 4), ("a.n", None, 5), (None, "T", 6)]
    return spark.createDataFrame(data, "obj_name string, table_kind string, ord long")


@pytest.fixture
def edges(spark):
    data = [("s", c, "Insert", p, q) for c, p, q in [
        ("a.x", "A.Y ", False), ("a.z", None, False), ("s.v", "a.n", False), ("run-s", "a.x", True), ("RUN", "zz", False), (None, "a.y", False),
    ]]
    return spark.createDataFrame(data, "script_file string, child_table_name string, relationship string, parent_table_name string, is_query boolean")


def test_last_row_wins(spark, types):
    assert rows(C.catalog_lookup(types)) == [("A.N", None), ("A.X", "T"), ("A.Y", "V"), ("A.Z", "O")]


def test_new_views(spark, types):
    views = spark.createDataFrame([("a.X ",), (" new",), ("new",), ("NEW",), (None,)], "view_name string")
    assert rows(C.new_views(types, views)) == [("NEW",), ("new",)]
    assert ("NEW", "V") in rows(C.catalog_lookup(C.extend_catalog(types, views)))


@pytest.mark.parametrize("default", ["VOLTABLE", "VIEW"])
def test_types(spark, types, edges, default):
    got = rows(C.add_table_types(edges, types, "run", default), "child_table_name", "parent_table_name", "child_table_type", "parent_table_type")
    assert got == [
        ("RUN", "zz", "UNKNOWN", default), ("a.x", "A.Y ", "TABLE", "VIEW"), ("a.z", None, default, None),
        ("run-s", "a.x", "UNKNOWN", "TABLE"), ("s.v", "a.n", default, default), (None, "a.y", None, "VIEW"),
    ]


def test_types_without_catalog(spark, edges):
    got = rows(C.add_table_types(edges, None, "run"), "child_table_name", "child_table_type", "parent_table_type")
    assert {(c, p) for _, c, p in got} == {("VIEW", "VIEW"), ("UNKNOWN", "VIEW")}
    assert [n for n, c, _ in got if c == "UNKNOWN"] == ["RUN", "run-s"]


def test_names(spark):
    df = spark.createDataFrame([("t",), ("a.t",), (None,)], "n string")
    assert rows(df.select(qualify(F.col("n"), F.lit("scr")))) == [("a.t",), ("scr.t",), (None,)]
    assert rows(normalise_case(df.selectExpr("n", "1 AS i"))) == [("A.T", 1), ("T", 1), (None, 1)]


def test_catalog_is_not_forced_into_a_broadcast(spark, types, edges):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.add_table_types(edges, types)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan
