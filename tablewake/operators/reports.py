"""Counts and shares of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import LEVELS, is_level_row, path_counts
from .resolve import is_volatile


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1))


def run_statistics(parsed: DataFrame, include_query_edges: bool = False) -> DataFrame:
    """Statements in all, converted and failed, with percentages, and edges, in one pass.

    The number of edges of a statement follows from its kind and the sizes of its target and source lists.
    """
    kind, targets, sources = F.col("kind"), F.size("targets"), F.size("sources")
    written = targets * F.greatest(sources, F.lit(1)) + (targets if include_query_edges else 0)
    edges = F.when(kind == "Select", sources).when(kind == "Delete", targets * sources).otherwise(written)
    failed = F.col("error_type").isNotNull().cast("bigint")
    zero = F.lit(0).cast("bigint")
    counts = parsed.agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.sum(failed), zero).alias("failed_queries"),
        F.coalesce(F.sum(F.when(kind.isNotNull(), edges)), zero).alias("lineage_relationships"),
    )
    total, bad = F.col("total_queries"), F.col("failed_queries")
    return counts.select(
        total,
        (total - bad).alias("successful_queries"),
        bad,
        _percent(total - bad, total).alias("successful_pct"),
        _percent(bad, total).alias("failed_pct"),
        "lineage_relationships",
    )


def error_histogram(parsed: DataFrame) -> DataFrame:
    """Failed statements per error type, with their share, most frequent first."""
    counts = parsed.groupBy("error_type").agg(F.count("error_type").alias("n")).where("n > 0")
    # The window holds one row per error type.
    share = _percent(F.col("n"), F.sum("n").over(Window.partitionBy()))
    return counts.select("error_type", "n", share.alias("pct")).orderBy(F.desc("n"), "error_type")


def resolution_statistics(prepared: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows ``metric, table_type, n``: sizes before and after, volatile tables, types of the children."""
    volatile = is_volatile("child_table_type")

    def per_type(df: DataFrame, stage: str) -> DataFrame:
        """Counts per child type; totals follow from these few rows."""
        return df.groupBy("child_table_type").agg(F.count("*").alias("n")).withColumn("stage", F.lit(stage))

    types = per_type(prepared, "input").unionByName(per_type(resolved, "output"))
    signed = F.when(F.col("stage") == "output", F.col("n")).otherwise(-F.col("n"))
    totals = types.agg(
        F.sum(F.when(F.col("stage") == "input", F.col("n"))).alias("input_relationships"),
        F.sum(F.when(F.col("stage") == "output", F.col("n"))).alias("output_relationships"),
        F.sum(F.when((F.col("stage") == "input") & volatile, F.col("n"))).alias("relationships_removed"),
        F.sum(signed).alias("net_change"),
    )
    metrics = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.coalesce(name, F.lit(0)).alias("n"))
                    for name in totals.columns
                ]
            )
        ).alias("m")
    ).select("m.metric", F.lit(None).cast("string").alias("table_type"), "m.n")
    tables = prepared.where(volatile).agg(F.countDistinct("child_table_name").alias("n")).select(
        F.lit("volatile_tables").alias("metric"), F.lit(None).cast("string").alias("table_type"), "n"
    )
    spread = types.where(F.col("child_table_type").isNotNull()).select(
        F.concat("stage", F.lit("_type")).alias("metric"), F.col("child_table_type").alias("table_type"), "n"
    )
    return metrics.unionByName(tables).unionByName(spread)


def hierarchy_statistics(df: DataFrame) -> DataFrame:
    """Input rows per level, and of relationships, in one pass."""
    name = F.when(is_level_row(), F.col("parent_table_type")).otherwise("Relationship")
    return df.groupBy(name.alias("level")).agg(F.count("*").alias("n"))


def join_statistics(df: DataFrame) -> DataFrame:
    """Rows after each full outer join of the hierarchy, from counts by name."""
    counts = [n.select(F.lit(name).alias("joined_on"), "n") for name, n in zip(LEVELS[1:], path_counts(df))]
    return reduce(DataFrame.unionByName, counts)
