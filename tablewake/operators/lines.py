"""Lines of logs and scripts, and the statements they form.

A frame of lines has the group columns (``keys``), ``block``, ``pos`` and ``line``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import save_point
from .scans import BLOCK_ROWS, assemble_text, block_of, scan_before, scan_two_states

KEYS = ("script_file",)


def with_blocks(lines: DataFrame, rows: int = BLOCK_ROWS, pos: str = "pos") -> DataFrame:
    """Add ``block`` to lines that are numbered within their group; unnumbered ones go last."""
    end = F.lit((1 << 63) - 1).cast("bigint")
    return lines.withColumn("block", F.coalesce(block_of(pos, rows), end))


def split_lines(texts: DataFrame, text: str = "text", rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per line of a text column, numbered from 0."""
    others = [c for c in texts.columns if c != text]
    lines = texts.select(*others, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return with_blocks(lines.withColumn("pos", F.col("pos").cast("bigint")), rows)


def line_classes(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.select(
        "*",
        T.is_dropped(line).alias("is_dropped"),
        T.is_log_noise(line).alias("is_log_noise"),
        T.is_statement_start(line).alias("is_start"),
        T.ends_statement(line).alias("is_end"),
    )


def drop_noise(lines: DataFrame) -> DataFrame:
    return lines.where(~T.is_dropped(F.col("line")))


def _read_outside(line: Column) -> tuple[Column, Column, Column]:
    """Of a line met outside a comment: the text kept, the text from an unclosed ``/*`` on, and whether
    there is one."""
    kept = F.split(line, T.BLOCK_COMMENT, -1)
    tail = F.element_at(kept, -1)
    at = F.instr(tail, "/*")
    head = F.array_join(F.slice(kept, 1, F.size(kept) - 1), "")
    return (
        F.when(at > 0, F.concat(head, F.substring(tail, F.lit(1), at - 1))).otherwise(F.concat(head, tail)),
        F.when(at > 0, F.substring(tail, at, F.length(tail))).otherwise(""),
        at > 0,
    )


def strip_comment_lines(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Remove ``/* */`` comments from numbered lines, as `strip_block_comments` does from a whole text.

    One scan says for each line whether it begins inside a comment; its outcome is written to the shared folder, without the lines
    that a comment hides. Lines that a comment had run together come back as one line, at the place of the first.
    """
    line = F.col("line")
    lines = lines.select(*keys, "block", "pos", F.coalesce(line, F.lit("")).alias("line"))
    marked = line.contains("/*") | line.contains("*/")
    close = F.instr(line, "*/")
    outside = _read_outside(line)
    inside = _read_outside(F.substring(line, close + 2, F.length(line)))
    # A line without a mark leaves the state as it is.
    after_outside = F.when(marked, outside[2]).otherwise(False)
    after_inside = F.when(marked, (close == 0) | inside[2]).otherwise(True)
    scanned = scan_two_states(lines, keys, (after_outside, after_inside), close > 0)

    at = F.struct("block", "pos")
    begins_inside = F.col("state") == 1
    literal = F.coalesce(at > F.col("unclosed"), F.lit(False))
    reopened = F.coalesce(at == F.col("unclosed"), F.lit(False))
    kept = F.when(begins_inside, inside[0]).otherwise(outside[0])
    tail = F.when(begins_inside, inside[1]).otherwise(outside[1])
    follows = begins_inside & ~literal
    goes_on = F.when(begins_inside, after_inside).otherwise(after_outside) & ~literal & ~reopened
    text = F.when(literal | ~marked, line).when(reopened, F.concat(kept, tail)).otherwise(kept)
    outcome = save_point(
        scanned.where(~follows | (close > 0)).select(
            *keys, "block", "pos", text.alias("line"),
            (follows | goes_on).alias("joined"),
            F.when(follows, F.col("head")).otherwise(at).alias("head"),
        )
    )
    alone = outcome.where("NOT joined").select(*keys, "block", "pos", "line")
    pieces = outcome.where("joined").select("*", F.col("head.block").alias("head_block"), F.col("head.pos").alias("head_pos"))
    joined = assemble_text(pieces, [*keys, "head_block", "head_pos"], "line", sep="")
    return alone.unionByName(joined.select(*keys, F.col("head_block").alias("block"), F.col("head_pos").alias("pos"), "line"))


def sessionise(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the lines that belong to statements and say which statement.

    Between two end lines there is at most one statement: it runs from the first start line to the end
    line. So the place of the end line before it names a statement: ``after_block``, ``after_pos``
    (-1 at the top of a log).
    """
    lines = drop_noise(lines.select(*keys, "block", "pos", "line"))
    line = F.col("line")
    scanned = scan_before(
        lines.withColumn("is_end", T.ends_statement(line)).withColumn("is_start", T.is_statement_start(line)),
        keys,
        last={
            "inside": F.when(F.col("is_end"), F.lit(False)).when(F.col("is_start"), F.lit(True)),
            "after_block": F.when(F.col("is_end"), F.col("block")),
            "after_pos": F.when(F.col("is_end"), F.col("pos")),
        },
    )
    inside = F.coalesce("inside", F.lit(False))
    return scanned.where(inside | F.col("is_start")).select(
        *keys, "block", "pos", "line",
        (F.col("is_start") & ~inside).alias("begins"),
        F.coalesce("after_block", F.lit(-1)).alias("after_block"),
        F.coalesce("after_pos", F.lit(-1)).alias("after_pos"),
    )


def assemble_statements(session_lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per statement of a log, placed at its first line."""
    whole = assemble_text(session_lines, [*keys, "after_block", "after_pos"], "line")
    return whole.select(*keys, "block", "pos", F.col("line").alias("sql_text"))


def clean_log(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Raw log lines to the lines of statements: comments, noise and console output gone."""
    return sessionise(strip_comment_lines(lines, keys), keys)


def log_statements(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Raw log lines to statements as the log gives them; one may hold several, cut by semicolons."""
    return assemble_statements(clean_log(lines, keys), keys)
