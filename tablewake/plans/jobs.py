"""The whole jobs: files in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalise_case
from ..operators.catalog import add_table_types, extend_catalog
from ..operators.extract import extract_edges, parse_statements, statement_errors
from ..operators.hierarchy import build_hierarchy, flatten_hierarchy, relationship_rows
from ..operators.lines import clean_log
from ..operators.reports import (
    error_histogram,
    hierarchy_statistics,
    resolution_statistics,
    run_statistics,
)
from ..operators.resolve import prepare_relations, resolve_volatile, sort_relations
from ..operators.statements import (
    split_statement_lines,
    table_statements,
    with_query_index,
)
from ..session import job_save_points, save_point
from ..sources.files import FILE_KEYS, read_log_lines, read_script_lines, script_files, table_files
from ..sources.sinks import staged, write_cleaned, write_errors, write_hierarchy, write_relations
from ..sources.tables import read_line_table


def _told(df: DataFrame) -> DataFrame:
    """The few rows of a report, independent of intermediate tables."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def script_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of all script files below a path."""
    return split_statement_lines(read_script_lines(spark, path), FILE_KEYS)


def log_file_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of all logs below a path: the lines kept, cut at ``;``, with no file between."""
    return split_statement_lines(clean_log(read_log_lines(spark, path), FILE_KEYS), FILE_KEYS)


def lineage_edges(
    statements: DataFrame,
    run_name: str,
    types: DataFrame | None = None,
    default: str = "VOLTABLE",
    include_query_edges: bool = False,
    per_script: bool = True,
) -> DataFrame:
    """Statements to typed, upper-cased edges."""
    edges = extract_edges(parse_statements(statements), run_name, include_query_edges, per_script)
    return normalise_case(add_table_types(edges, types, run_name, default))


def lineage_job(
    statements: DataFrame,
    out: str,
    run_name: str,
    types: DataFrame | None = None,
    views: DataFrame | None = None,
    default: str = "VOLTABLE",
    include_query_edges: bool = False,
    per_script: bool = True,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Write edges and errors of a run; return its statistics.

    Statements are parsed once and written; edges, errors and counts all read from there. Edges and errors come to ``out`` together
    or, if the job fails, not at all. The rules of the
    sequential variant are ``default="VIEW"``, ``include_query_edges=True`` and ``per_script=False``.
    """
    with job_save_points(statements.sparkSession), staged(statements.sparkSession, out) as folder:
        return _lineage_job(
            statements, folder, run_name, types, views, default, include_query_edges, per_script, fmt
        )


def _lineage_job(
    statements, out, run_name, types, views, default, include_query_edges, per_script, fmt
) -> dict[str, DataFrame]:
    place = [c for c in ("script_file", "file_path", "query_name", "pos") if c in statements.columns]
    # A row's own number: places may be null or repeat, so they cannot lead an error back to its statement.
    parsed = save_point(parse_statements(statements).withColumn("_id", F.monotonically_increasing_id()))
    edges = extract_edges(parsed, run_name, include_query_edges, per_script)
    if types is not None and views is not None:
        types = extend_catalog(types, views)
    typed = normalise_case(add_table_types(edges, types, run_name, default))
    write_relations(typed, f"{out}/{run_name}-relations", fmt)
    failed = parsed.where(F.col("error_type").isNotNull())
    if not failed.isEmpty():
        # Only the keys of all statements are sorted and numbered; the texts of the failed ones join them.
        numbers = with_query_index(parsed.select(*place, "_id"), [*place, "_id"]).select("_id", "query_index")
        numbered = failed.join(numbers, "_id")
        write_errors(statement_errors(numbered), f"{out}/{run_name}-error_details")
    return {"statistics": _told(run_statistics(parsed, include_query_edges)), "errors": _told(error_histogram(parsed))}


def script_lineage_job(spark: SparkSession, path: str, out: str, run_name: str, **options) -> dict[str, DataFrame]:
    with job_save_points(spark):
        return lineage_job(script_statements(spark, path), out, run_name, **options)


def table_lineage_job(lines: DataFrame, out: str, run_name: str, **options) -> dict[str, DataFrame]:
    """The lineage job over a line table (see `read_script_table`)."""
    return lineage_job(table_statements(lines), out, run_name, **options)


def folder_lineage_job(
    spark: SparkSession, path: str, out: str, run_name: str, types: DataFrame | None = None, views: DataFrame | None = None, **options
) -> dict[str, DataFrame]:
    """The lineage job over all scripts and line tables of a folder and all below it, or over one file.

    Line tables come as CSV or Parquet. What their columns ``view_name`` hold extends the catalog, with ``views`` if given.
    """
    with job_save_points(spark):
        tables = [read_line_table(spark, name) for name in table_files(spark, path)]
        parts = [table_statements(lines) for lines, _ in tables]
        if script_files(spark, path) or not parts:
            parts.insert(0, script_statements(spark, path))
        found = [v for v in (views, *(v for _, v in tables)) if v is not None]
        statements = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        all_views = reduce(DataFrame.unionByName, found) if found else None
        return lineage_job(statements, out, run_name, types=types, views=all_views, **options)


def log_lineage_job(spark: SparkSession, path: str, out: str, run_name: str, **options) -> dict[str, DataFrame]:
    with job_save_points(spark):
        return lineage_job(log_file_statements(spark, path), out, run_name, **options)


def clean_logs_job(spark: SparkSession, path: str, out: str) -> None:
    """Write the statements of each log as SQL text."""
    with job_save_points(spark):
        write_cleaned(clean_log(read_log_lines(spark, path), FILE_KEYS), out)


def resolve_job(relations: DataFrame, out: str, fmt: str = "parquet", max_depth: int | None = None) -> DataFrame:
    """Write the sorted edges without volatile tables; return the statistics."""
    with job_save_points(relations.sparkSession):
        prepared = save_point(prepare_relations(relations))
        resolved = save_point(resolve_volatile(prepared, max_depth, prepared=True))
        folder, _, name = out.rstrip("/").rpartition("/")
        with staged(prepared.sparkSession, folder or ".") as stage:
            write_relations(sort_relations(resolved), f"{stage}/{name}", fmt)
        return _told(resolution_statistics(prepared, resolved))


def hierarchy_job(
    relations: DataFrame, out: str, fmt: str = "csv", match_null_keys: bool = False
) -> DataFrame:
    """Write hierarchy, relationships and flattened edges; return the row counts per level.

    ``match_null_keys`` pairs every relationship that names no object with every path that has none.
    """
    with job_save_points(relations.sparkSession):
        hierarchy = save_point(build_hierarchy(relations))
        edges = relationship_rows(relations)
        write_hierarchy(hierarchy, edges, flatten_hierarchy(edges, hierarchy, match_null_keys), out, fmt)
        return _told(hierarchy_statistics(relations))
