"""Line tables, object catalogs and edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import stem
from ..functions.text import unify_newlines

# Headers looked for, in this order.
TEXT_HEADERS = ("query", "Query", "QUERY", "sql", "SQL", "Sql", "view_sql", "VIEW_SQL", "View_SQL")
LINE_HEADERS = ("LineNumber", "linenumber", "line_number", "Line_Number", "LINENUMBER")
NAME_HEADERS = ("TableName", "ViewName", "SQLName", "view_name", "QueryNumber", "query_number")

CANONICAL = (
    "script_file",
    "child_table_name",
    "relationship",
    "parent_table_name",
    "child_table_type",
    "parent_table_type",
    "obj_name",
    "table_kind",
)
# Headers of the sequential job for the two type columns.
OTHER_SPELLINGS = {"childtypes": "child_table_type", "parenttypes": "parent_table_type"}


class LineColumns(NamedTuple):
    text: str
    line_number: str
    query_name: str


def discover_columns(columns: Sequence[str]) -> LineColumns:
    """The columns of a line table: by header, else the last, the last but one and the first."""

    def first(headers: Sequence[str], fallback: int) -> str:
        found = [h for h in headers if h in columns]
        if found:
            return found[0]
        if len(columns) < abs(fallback):
            raise ValueError(f"no line-number column among {list(columns)}")
        return columns[fallback]

    return LineColumns(first(TEXT_HEADERS, -1), first(LINE_HEADERS, -2), first(NAME_HEADERS, 0))


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """By the name of the file or folder, or of the files in the folder."""
    if path.rstrip("/").endswith(".parquet"):
        return True
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(folder, "*.parquet")
    )
    return found is not None and len(found) > 0


def _read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    if _is_parquet(spark, path):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')


def _row_order(scanned: bool = True) -> Column:
    """Where a row stands in its source: its file by name, the block of it by offset, and the row, whose number grows within a
    block. Blocks are packed into tasks by size, so the number alone is no order over several."""
    row = F.monotonically_increasing_id().alias("row")
    if scanned:
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row)
    return F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("block"), row)


def read_script_table(
    spark: SparkSession, source: str | DataFrame, script_file: str | None = None, multi_line: bool = False
) -> DataFrame:
    """A line table as ``script_file, query_name, line_number, row_number, line``.

    ``source`` is a CSV or Parquet path or a DataFrame. ``row_number`` grows with the row order of the source, over several
    files by their names, and settles equal line numbers. Numbers may have fractions and may be written as text; what is no number
    is kept in ``row_number``, before the row, and is put in the order of its text.
    """
    scanned = isinstance(source, str)
    if scanned:
        df = _read(spark, source, multi_line)
        script = F.lit(script_file) if script_file else stem(F.col("_metadata.file_name"))
    else:
        df, script = source, F.lit(script_file or "table")
    found = discover_columns(df.columns)
    number = F.expr(f"try_cast(`{found.line_number}` AS double)")
    return df.select(
        script.alias("script_file"),
        F.col(found.query_name).cast("string").alias("query_name"),
        number.alias("line_number"),
        F.struct(
            F.when(number.isNull(), F.col(found.line_number).cast("string")).alias("text"),
            _row_order(scanned).alias("row"),
        ).alias("row_number"),
        unify_newlines(F.col(found.text).cast("string")).alias("line"),
    )


def read_line_table(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """A line table as `read_script_table` gives it, and the view names it brings along, if any."""
    return read_script_table(spark, path, multi_line=multi_line), view_names(_read(spark, path, multi_line))


def view_names(df: DataFrame) -> DataFrame | None:
    """The view names a line table brings along, if it has a column ``view_name``."""
    return df.select(F.col("view_name").cast("string")) if "view_name" in df.columns else None


def _canonical(df: DataFrame) -> DataFrame:
    """Column names by their lower-case letters, so that all spellings and orders work."""
    known = {name.replace("_", ""): name for name in CANONICAL} | OTHER_SPELLINGS
    return df.toDF(*[known.get(c.replace("_", "").strip().lower(), c) for c in df.columns])


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Typed edges from CSV or Parquet; every column a string, only the empty field is null."""
    return _canonical(_read(spark, path))


def read_object_types(spark: SparkSession, path: str) -> DataFrame:
    """Object catalog ``obj_name, table_kind``; ``ord`` is the order of rows, over several files by their names."""
    # The order is taken where the files are read, since a renamed frame shows no file any more.
    read = _read(spark, path)
    return _canonical(read.select("*", _row_order().alias("ord"))).select("obj_name", "table_kind", "ord")
