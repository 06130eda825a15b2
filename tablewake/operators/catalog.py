"""Object catalog and table types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import lookup_key, spread_nulls
from ..functions.text import strip


def new_views(types: DataFrame, views: DataFrame) -> DataFrame:
    """Distinct view names that the catalog lacks, by the form in which names are compared."""
    names = views.where(F.col("view_name").isNotNull()).select(strip(F.col("view_name")).alias("obj_name"))
    known = types.select(lookup_key(F.col("obj_name")).alias("_key")).distinct()
    return names.distinct().withColumn("_key", F.upper("obj_name")).join(known, "_key", "left_anti").drop("_key")


def extend_catalog(types: DataFrame, views: DataFrame) -> DataFrame:
    """The catalog with the view names of a script table that it lacks, as views, after all its rows."""
    nowhere = F.lit(None).cast(types.schema["ord"].dataType).alias("ord")
    added = new_views(types, views).select("obj_name", F.lit("V").alias("table_kind"), nowhere)
    return types.select("obj_name", "table_kind", "ord").unionByName(added)


def catalog_lookup(types: DataFrame) -> DataFrame:
    """One row per name: the kind of its last catalog row by ``ord``, rows without a place after all others."""
    place = F.struct(F.col("ord").isNull(), "ord")
    return (
        types.where(F.col("obj_name").isNotNull())
        .groupBy(lookup_key(F.col("obj_name")).alias("key"))
        .agg(F.max_by(strip(F.col("table_kind")), place).alias("table_kind"))
    )


def _type_of(name: Column, kind: Column, default: str) -> Column:
    return F.when(
        name.isNotNull(), F.when(kind == "V", "VIEW").when(kind == "T", "TABLE").otherwise(default)
    )


def add_table_types(
    edges: DataFrame, types: DataFrame | None = None, run_name: str | None = None, default: str = "VOLTABLE"
) -> DataFrame:
    """Add ``child_table_type`` and ``parent_table_type``.

    Without a catalog every table is a view. The query's own name is UNKNOWN. The catalog has no
    broadcast hint: the planner broadcasts it only below its size threshold and otherwise joins by
    shuffle, where adaptive execution splits names that many edges share.
    """
    child, parent = F.col("child_table_name"), F.col("parent_table_name")
    is_query = F.lit(False) if run_name is None else F.upper(child) == run_name.upper()
    if "is_query" in edges.columns:
        is_query = F.col("is_query") | is_query
    plain = [c for c in edges.columns if c != "is_query"]
    if types is None:
        return edges.select(
            *plain,
            F.when(is_query, "UNKNOWN").otherwise("VIEW").alias("child_table_type"),
            F.lit("VIEW").alias("parent_table_type"),
        )
    kinds = catalog_lookup(types)
    for_child = kinds.select(F.col("key").alias("_child_key"), F.col("table_kind").alias("_child_kind"))
    for_parent = kinds.select(F.col("key").alias("_parent_key"), F.col("table_kind").alias("_parent_kind"))
    return (
        edges.withColumn("_child", spread_nulls(lookup_key(child), parent))
        .withColumn("_parent", spread_nulls(lookup_key(parent), child))
        .join(for_child, F.col("_child") == F.col("_child_key"), "left")
        .join(for_parent, F.col("_parent") == F.col("_parent_key"), "left")
        .select(
            *plain,
            F.when(child.isNotNull() & is_query, "UNKNOWN")
            .otherwise(_type_of(child, F.col("_child_kind"), default))
            .alias("child_table_type"),
            _type_of(parent, F.col("_parent_kind"), default).alias("parent_table_type"),
        )
    )
