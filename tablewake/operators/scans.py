"""Ordered scans over groups of any size.

A log, script or query may hold a large share of all lines, so no operator here puts a whole group
into one task. Lines carry a ``block`` number: a stretch of neighbouring lines of one group, bounded in
size (a file split, or a range of line numbers). Each block is worked on by itself; what a block
has to know of the earlier ones is one small row, computed from one aggregate row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

BLOCK_ROWS = 100_000


def block_of(position: str, rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"cast(floor(`{position}`) AS bigint) div {rows}")


def _named_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with keys that are never null: a null name becomes the empty name, and a key of another kind that may be null goes by
    its text. Also these keys, and the columns added for them."""
    kinds = dict(df.dtypes)
    others = [c for c in keys if kinds[c] != "string" and df.schema[c].nullable]
    df = df.na.fill("", list(keys))
    if others:
        df = df.withColumns({f"_key_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others})
    return df, [f"_key_{c}" if c in others else c for c in keys], [f"_key_{c}" for c in others]


def _state_of(entry: Column, anchor: Column, parity: Column) -> Column:
    return (F.coalesce(anchor, entry) + parity) % 2


def scan_two_states(df: DataFrame, keys: Sequence[str], after: tuple[Column, Column], opens: Column, pos: str = "pos", block: str = "block") -> DataFrame:
    """Run a machine of two states, 0 at first, over the rows of each group.

    ``after``: the state behind a row by the state before it. ``opens``: whether a row that leaves state 1 enters it again.
    Adds ``state`` before each row; ``head``, the (block, pos) of the latest row met in state 0, itself
    included; ``unclosed``, where state 1 was last entered, if the group ends in it.

    A row's map of states is a constant, a flip or neither, so a state is the last constant, flipped as often as since. Rows
    are shuffled once. Each block becomes one row with its map and what it would add for either state before it; these are
    composed along each group and joined back.
    """
    df, names, added = _named_keys(df, keys)
    group = [*names, block]
    zero, one = (F.lit(n).cast("int") for n in (0, 1))
    rows = df.withColumns({"_0": after[0].cast("int"), "_1": after[1].cast("int"), "_opens": opens})

    def composed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        flips = F.sum(F.when(F.col("_0") > F.col("_1"), 1)).over(earlier)
        rows = rows.withColumn("_parity", (F.coalesce(flips, F.lit(0)) % 2).cast("int"))
        fixed = F.when(F.col("_0") == F.col("_1"), (F.col("_0") + F.col("_parity")) % 2)
        return rows.withColumn("_anchor", F.last(fixed, ignorenulls=True).over(earlier))

    anchor, parity = F.col("_anchor"), F.col("_parity")
    upto = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = [_state_of(entry, anchor, parity) for entry in (zero, one)]
    rows = composed(rows, group, pos).withColumns({f"_before{e}": before[e] for e in (0, 1)})
    rows = rows.withColumns({f"_head{e}": F.last(F.when(F.col(f"_before{e}") == 0, F.col(pos)), ignorenulls=True).over(upto) for e in (0, 1)})
    behind = [F.when(F.col(f"_before{e}") == 1, F.col("_1")).otherwise(F.col("_0")) for e in (0, 1)]
    entered = [(behind[e] == 1) & ((F.col(f"_before{e}") == 0) | F.col("_opens")) for e in (0, 1)]
    blocks = rows.groupBy(*group).agg(
        *[F.max_by(behind[e], pos).alias(f"_{e}") for e in (0, 1)],
        *[F.max(F.when(entered[e], F.col(pos))).alias(f"_entered{e}") for e in (0, 1)],
        *[F.max(F.when(F.col(f"_before{e}") == 0, F.col(pos))).alias(f"_outside{e}") for e in (0, 1)],
    )
    blocks = composed(blocks, names, block).withColumn("_entry", _state_of(zero, anchor, parity))
    really = lambda name: F.when(F.col("_entry") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    place = lambda value: F.when(value.isNotNull(), F.struct(F.col(block).alias("block"), value.alias("pos")))
    blocks = blocks.select(*group, "_entry", really("_").alias("_end"), place(really("_entered")).alias("_entered"), place(really("_outside")).alias("_outside"))
    earlier = Window.partitionBy(*names).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    blocks = blocks.select(
        *group, "_entry",
        F.last("_outside", ignorenulls=True).over(earlier).alias("_earlier"),
        F.max_by("_end", block).over(whole).alias("_last"),
        F.max("_entered").over(whole).alias("_entered"),
    )
    return rows.join(blocks, group).select(
        *[c for c in df.columns if c not in added],
        really("_before").alias("state"),
        F.coalesce(place(really("_head")), F.col("_earlier")).alias("head"),
        F.when(F.col("_last") == 1, F.col("_entered")).alias("unclosed"),
    )


def scan_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("pos",),
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    block: str = "block",
) -> DataFrame:
    """Add to each row what the rows before it in its group amount to.

    ``last``: the latest non-null value before the row (null if none). ``total``: the sum before the row
    (0 if none). The summary per block is a plain aggregate, combined before its shuffle (by hashing, if
    the values have a fixed width); the rows themselves are shuffled once, by group and block, and stay
    so partitioned.
    """
    last, total = dict(last or {}), dict(total or {})
    names = [*last, *total]
    # An inner join with the summary: as both sides then filter keys alike, a later scan of the result
    # finds the shuffled rows again. So that no row is lost, no key is null.
    df, keys, added = _named_keys(df, keys)
    group = [*keys, block]
    rows = df.select("*", *[value.alias(f"_{name}") for name, value in {**last, **total}.items()])

    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    summary = rows.groupBy(*group).agg(
        *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), place)).alias(f"_{n}") for n in last],
        *[F.sum(f"_{n}").alias(f"_{n}") for n in total],
    )
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *group,
        *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in last],
        *[F.sum(f"_{n}").over(earlier).alias(f"_in_{n}") for n in total],
    )

    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return rows.join(carried, group).select(
        *[c for c in df.columns if c not in [*names, *added]],
        *[
            F.coalesce(F.last(f"_{n}", ignorenulls=True).over(within), F.col(f"_in_{n}")).alias(n)
            for n in last
        ],
        *[
            (F.coalesce(F.sum(f"_{n}").over(within), zero) + F.coalesce(F.col(f"_in_{n}"), zero)).alias(n)
            for n in total
        ],
    )


def assemble_text(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    order: Sequence[str] = ("pos",),
    sep: str = "\n",
    block: str = "block",
) -> DataFrame:
    """Join the pieces of each group in order: first within a block, then the blocks' texts.

    The first step keeps the partitioning by group and block that `scan_before` leaves; the second
    moves one row per block. Also returns the ``block`` and first order column of the first piece.
    """
    first = order[0]
    piece = F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_piece"))
    parts = df.groupBy(*keys, block).agg(
        _join_in_order(piece, "_piece", sep).alias("_part"), F.min(first).alias("_first")
    )
    whole = parts.groupBy(*keys).agg(
        _join_in_order(F.struct(block, "_part"), "_part", sep).alias(text),
        F.min(block).alias("_block"),
        F.min_by("_first", block).alias("_first"),
    )
    return whole.select(*keys, F.col("_block").alias(block), F.col("_first").alias(first), text)


def _join_in_order(piece: Column, text: str, sep: str) -> Column:
    """The texts of a group, joined in the order of the fields before them."""
    return F.array_join(F.sort_array(F.collect_list(piece)).getField(text), sep)


def text_digest(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], sep: str = "\n") -> DataFrame:
    """``n_chars`` and ``sha`` (SHA-256 of the UTF-8) of the pieces of each group joined in order, without building that text.

    A digest takes its text from first to last, so a group's pieces pass through one task, a batch at a time; they should be
    texts of some lines (see `assemble_text`), which are sorted with less memory than the lines.
    """
    schema = StructType([df.schema[k] for k in keys]).add("n_chars", LongType()).add("sha", StringType())
    places = range(len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, sha = None, 0, None

        def row() -> pa.RecordBatch:
            values = [*group, n, sha.hexdigest()]
            arrays = [pa.array([v], t) for v, t in zip(values, [*kinds, pa.int64(), pa.string()])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in places]
            named = zip(*[batch.column(i).to_pylist() for i in places])
            for key, length, piece in zip(named, batch.column(len(keys)), batch.column(len(keys) + 1)):
                if key != group:
                    if group is not None:
                        yield row()
                    group, n, sha = key, 0, hashlib.sha256()
                else:
                    sha.update(sep.encode())
                    n += len(sep)
                sha.update(piece.as_buffer())
                n += length.as_py()
        if group is not None:
            yield row()

    piece = F.coalesce(F.col(text), F.lit(""))
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*keys, F.length(piece).alias("_n"), piece.cast("binary").alias("_piece")).mapInArrow(run, schema)
