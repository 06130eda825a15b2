"""Sharding along a Hilbert curve through document metadata (operator 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewake.llm.ordering import with_running_sum

SHARDS = 40
BITS = 6
ROW_BYTES = 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (rows of whole numbers below ``2 ** bits``) on the Hilbert curve through their cube.

    By bit-plane exchanges and inversions from the highest bit down (Skilling 2004), then the
    transposed bits are read off plane by plane.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    high = np.uint64(1 << (bits - 1))
    bit = high
    while bit > 1:
        below = bit - np.uint64(1)
        for i in range(dims):
            set_here = (x[i] & bit) != 0
            swap = np.where(set_here, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(set_here, x[0] ^ below, x[0]) ^ swap
            x[i] ^= swap
        bit >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = high
    while bit > 1:
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - np.uint64(1)), flip)
        bit >>= np.uint64(1)
    x ^= flip
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(plane)) & np.uint64(1))
    return out


def category_cell(value: Column, bits: int = BITS) -> Column:
    """A cell for a category, by its hash; null has cell 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("int")


def size_cell(value: Column, bits: int = BITS) -> Column:
    """A cell for a size: its logarithm in steps that reach 2**32 with the last one; null has cell 0."""
    steps = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * ((1 << bits) / 32))
    return F.least(F.coalesce(steps, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, carry: str | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``curve``, ``shard``, ``slot`` for each row of ``docs``.

    Language, source and size are quantised to ``bits`` bits each and put in the order of the Hilbert curve through the
    three, so a shard covers few values of each and readers can skip the others. Rows of one cell are ordered by
    text, so equal texts lie side by side, then by id. The order is cut into runs of equal bytes: a row
    belongs to the shard in which its middle byte falls, so a shard is off by a row's size at
    most. ``slot`` counts a shard's rows from 0. A null text has 16 bytes and checksum 0; null metadata have
    a cell of their own or share one; repeated rows are neighbours; other columns are ignored, but for
    ``carry``, which comes along.
    """

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([a, b, c]), bits).astype(np.int64))

    text = F.coalesce("text", F.lit(""))
    carried = [carry] if carry else []
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        category_cell(F.col("lang"), bits).alias("a"),
        category_cell(F.col("source"), bits).alias("b"),
        *carried,
    )
    rows = rows.withColumn("curve", curve("a", "b", size_cell(F.col("size"), bits))).drop("a", "b")
    order = [F.col(c) for c in ("curve", "text_hash", "text_crc32", "doc_id")]
    summed = with_running_sum(rows, order, bytes=F.col("size"), rows=F.lit(1).cast("long"))
    middle = F.col("bytes_before") + F.col("size") / 2
    placed = summed.withColumn("shard", F.least(F.floor(middle * shards / F.col("bytes_total")), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "curve", "shard", (F.col("rows_before") - F.col("first")).alias("slot"), *carried
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Every row of ``docs`` once, as a folder for each shard, rows in slot order.

    Rows travel whole through the placement, so null and repeated ids do no harm.
    """
    whole = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    placed = hilbert_shards(whole, shards, carry="__row").select("shard", "slot", "__row")
    dealt = placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    dealt.select("__row.*", "shard").write.partitionBy("shard").parquet(path)
