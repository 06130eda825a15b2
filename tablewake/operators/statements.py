"""From scripts and line tables to single statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import save_point
from .lines import KEYS, with_blocks
from .scans import BLOCK_ROWS, assemble_text, scan_before


def split_statements(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cut each text at every ``;``; ``pos`` is the place of the statement in its text."""
    others = [c for c in texts.columns if c != text]
    pieces = texts.select(*others, F.posexplode(F.split(text, ";", -1)).alias("pos", "sql_text"))
    return pieces.withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "sql_text", strip(F.col("sql_text"))
    ).where("sql_text != ''")


def split_statement_lines(
    lines: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("pos",)
) -> DataFrame:
    """As `split_statements` over the joined lines of each group, without ever building that text.

    A line with n semicolons ends n statements; the number of semicolons before a line is
    the number of the statement it goes on with. Only single statements are assembled.
    """
    text = F.coalesce("line", F.lit(""))
    ended = F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))
    placed = scan_before(lines, keys, order, total={"_first": ended.cast("bigint")})
    pieces = placed.select(
        *keys, "block", *[c for c in order if c not in keys], "_first",
        F.posexplode(F.split(text, ";", -1)).alias("_nth", "sql_text"),
    ).withColumn("statement", F.col("_first") + F.col("_nth"))
    # Equal lines share their place; the number of the statement before them tells them apart.
    whole = assemble_text(pieces, [*keys, "statement"], "sql_text", (*order, "_first"))
    return whole.select(
        *keys, F.col("statement").alias("pos"), strip(F.col("sql_text")).alias("sql_text")
    ).where("sql_text != ''")


def _line_order(lines: DataFrame) -> list[str]:
    """By line number, what is no number by its text, equal ones as they come; by line only if no order is known."""
    return [c for c in ("line_number", "row_number") if c in lines.columns] + ["line"]


def assemble_queries(lines: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Text of each named query: its lines in the order of `_line_order`. Unnamed lines go."""
    named = with_blocks(lines.where(F.col("query_name").isNotNull()), rows, "line_number")
    named = named.withColumn("line", F.coalesce("line", F.lit("")))
    whole = assemble_text(
        named.withColumn("query_text", F.col("line")), ["script_file", "query_name"], "query_text", _line_order(named)
    )
    return whole.select("script_file", "query_name", "query_text")


def table_statements(lines: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Statements of a line table.

    Each query is cut at ``;`` by itself. That gives what cutting the script would give, all its queries
    joined by ``;``, without building that text.
    """
    named = with_blocks(lines.where(F.col("query_name").isNotNull()), rows, "line_number")
    named = named.withColumn("line", F.coalesce("line", F.lit("")))
    return split_statement_lines(named, ["script_file", "query_name"], _line_order(named))


def with_query_index(statements: DataFrame, order: Sequence[str] = ("script_file", "pos")) -> DataFrame:
    """Number all statements of a run from 0 in the order given, without a single-task sort.

    The rows are range-partitioned, sorted and written; a row's number is its place in its file
    plus the sizes of the files before it. Only one row per file passes through one task.
    """
    out = [c for c in statements.columns if c != "query_index"]
    sorted_rows = statements.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save_point(sorted_rows.select(*out)).select(
        *out, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy(F.regexp_extract("_file", r"part-(\d+)", 1).cast("bigint")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per written file: the number of shuffle partitions bounds this side.
    return placed.join(F.broadcast(offsets), "_file").select(
        *out, (F.col("_offset") + F.col("_row")).alias("query_index")
    )
