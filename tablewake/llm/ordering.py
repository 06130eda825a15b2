"""Running sums over one global order, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewake.session import save_point


def with_running_sum(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``df`` with, for each named value, its sum over all rows before in the order: ``<name>_before``, and over
    all rows: ``<name>_total``.

    The rows are dealt out by ranges of the order and written; each range's sums, a row for each
    partition, are carried over the ranges; within a range a window adds up. No task gets more than a range.
    """
    named = df.select("*", *[c.alias(f"__{n}") for n, c in values.items()], *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    sorting = [f"__o{i}" for i in range(len(order))]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save_point(named.repartitionByRange(ranges, *sorting).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__s_{n}") for n in values])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "__part",
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values],
        *[F.sum(f"__s_{n}").over(everything).alias(f"{n}_total") for n in values],
    )
    inside = Window.partitionBy("__part").orderBy(*sorting).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(F.broadcast(parts), "__part")
    for n in values:
        so_far = F.col(f"__b_{n}") + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0))
        summed = summed.withColumn(f"{n}_before", so_far)
    return summed.select(*df.columns, *[f"{n}_{kind}" for n in values for kind in ("before", "total")])
