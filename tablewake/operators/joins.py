"""Left outer join that stays even when one key holds very many rows on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILLERS = 64


def left_join_even(left: DataFrame, right: DataFrame, key: Column, right_key: str, spread_by: Column) -> DataFrame:
    """Left outer join of string keys (null keys match nothing); drops ``right_key``.

    Adaptive execution splits a hot key on both sides of an inner join, but only on the left of an outer one.
    So a first join with the distinct keys marks the left rows that have a partner; those without go to
    one of a few filler rows of nulls, by hash; the join itself is inner.
    """
    known = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_key")).distinct()
    spark = left.sparkSession
    values = [f for f in right.schema if f.name != right_key]
    fillers = spark.range(FILLERS).select(
        F.concat(F.lit("\0"), F.col("id").cast("string")).alias("_key"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in values],
    )
    filler = F.concat(F.lit("\0"), F.pmod(F.xxhash64(spread_by), F.lit(FILLERS)).cast("string"))
    marked = (
        left.withColumn("_key", F.coalesce(key, filler))
        .join(known.withColumn("_known", F.lit(True)), "_key", "left")
        .withColumn("_key", F.when(F.col("_known"), F.col("_key")).otherwise(filler))
        .drop("_known")
    )
    partners = right.withColumnRenamed(right_key, "_key").unionByName(fillers)
    return marked.join(partners, "_key").drop("_key")
