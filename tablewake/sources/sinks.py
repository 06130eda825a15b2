"""Written results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ends_statement
from ..session import remove_folder

SAMPLE_ROWS = 10
#: Values come back as they were, blanks at their ends included.
CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _write(df: DataFrame, path: str, fmt: str, mode: str, **options: str) -> int:
    """Write and return the number of rows; a fresh folder that stays empty is removed again."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode(mode).options(**options).format(fmt).save(path)
    rows = seen.get["rows"]
    if rows == 0 and mode in ("error", "errorifexists", "overwrite"):
        remove_folder(df.sparkSession, path)
    return rows


@contextmanager
def staged(spark: SparkSession, out: str) -> Iterator[str]:
    """A hidden folder in ``out`` to write several tables to; they come to ``out`` together once the block ends, and not at all if
    it fails.

    Each table is moved whole. A table of the same name in ``out`` is an error before any is moved; if a move fails, those moved
    go again. Last a manifest lists what came: ``_published-<number>``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, number = path(out), uuid.uuid4().hex
    stage = path(target, f"_staged-{number}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    is_new = not system.exists(target)
    moved: list[tuple] = []
    try:
        yield stage.toString()
        parts = [f.getPath() for f in system.listStatus(stage)] if system.exists(stage) else []
        ends = [path(target, p.getName()) for p in parts]
        there = [e.toString() for e in ends if system.exists(e)]
        if there:
            raise FileExistsError(f"already written: {', '.join(sorted(there))}")
        for part, end in zip(parts, ends):
            if not system.rename(part, end):
                raise OSError(f"{part.toString()} could not be moved to {end.toString()}")
            moved.append(end)
        if parts:
            manifest = system.create(path(target, f"_published-{number}"), False)
            manifest.write("".join(sorted(f"{e.getName()}\n" for e in ends)).encode())
            manifest.close()
    except BaseException:
        for end in moved:
            system.delete(end, True)
        raise
    finally:
        system.delete(stage, True)
        if is_new and system.exists(target) and not system.listStatus(target):
            system.delete(target, False)


def write_relations(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> int:
    """Edges, raw or resolved; CSV gets a header."""
    return _write(df, path, fmt, mode, **(CSV_OPTIONS if fmt == "csv" else {}))


def write_errors(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Errors as CSV; texts span lines, so read back with ``multiLine``."""
    return _write(df, path, "csv", mode, **CSV_OPTIONS)


def write_cleaned(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The statement lines of logs as text, one folder per script, blank lines after each statement.

    No statement is assembled for this. The lines are range-partitioned by script and place, so a long log is
    written by many tasks; its files sort by name into the order of the log.
    """
    place = [c for c in ("script_file", "file_path", "block", "pos") if c in lines.columns]
    line = F.col("line")
    text = F.when(ends_statement(line), F.concat(line, F.lit("\n\n"))).otherwise(line).alias("value")
    ordered = lines.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.select("script_file", text).write.mode(mode).partitionBy("script_file").text(path)


def write_hierarchy(
    hierarchy: DataFrame, relationships: DataFrame, flattened: DataFrame, path: str, fmt: str = "csv"
) -> dict[str, int]:
    """Three tables that come to ``path`` together or not at all."""
    parts = {"hierarchy_table": hierarchy, "relationship_table": relationships, "final_output": flattened}
    with staged(hierarchy.sparkSession, path) as folder:
        return {name: write_relations(df, f"{folder}/{name}", fmt) for name, df in parts.items()}


def sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(rows)
