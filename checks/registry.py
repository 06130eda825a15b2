"""Queries by name: each takes (spark, folder of driver tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.functions import text as T
from tablewake.functions.names import normalise_case
from tablewake.operators import catalog, extract, hierarchy, lines, reports, resolve, statements
from tablewake.operators.scans import assemble_text, block_of, scan_before, text_digest
from tablewake.plans import jobs
from tablewake.plans.jobs import lineage_edges
from tablewake.session import save_point, shared_folder
from tablewake.sources.files import FILE_KEYS, read_log_lines, read_script_lines
from tablewake.sources.sinks import write_errors, write_relations
from tablewake.sources.tables import read_object_types, read_relations, read_script_table

from .fixtures import fixture, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN = "Nightly"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _documents(spark, sf):
    return table(spark, sf, "documents")


def _parsed(spark, sf):
    return extract.parse_statements(fixture(spark, sf, "fx_statements"))


def _joined(names: F.Column) -> F.Column:
    return F.array_join(F.array_sort(names), ",")


def _log_lines(spark, sf):
    return lines.with_blocks(fixture(spark, sf, "fx_log_lines"), 4096)


def _sql_lines(spark, sf):
    return lines.with_blocks(fixture(spark, sf, "fx_sql_lines"), 16384)


# --- text and lines -------------------------------------------------------------------------------


@query
def split_lines(spark, sf):
    texts = _documents(spark, sf).select("doc_id", "text")
    return lines.split_lines(texts).select("doc_id", "pos", "line")


@query
def strip_block_comments(spark, sf):
    marked = F.concat(F.lit("/* "), "source", F.lit(" */ "), "text", F.lit("/* tail\n*/"))
    return _documents(spark, sf).select("doc_id", T.strip_block_comments(marked).alias("text"))


@query
def strip_comment_lines(spark, sf):
    """Comments removed line by line, then the lines joined again: equals removal from the whole text."""
    numbered = lines.split_lines(fixture(spark, sf, "fx_commented"), rows=16)
    kept = lines.strip_comment_lines(numbered, ["doc_id"])
    return assemble_text(kept, ["doc_id"], "line").select("doc_id", F.col("line").alias("text"))


@query
def line_classes(spark, sf):
    classes = lines.line_classes(fixture(spark, sf, "fx_log_lines"))
    flags = [F.col(c).cast("int").alias(c) for c in ("is_dropped", "is_log_noise", "is_start", "is_end")]
    return classes.select("script_file", "pos", *flags)


@query
def sessionise_log(spark, sf):
    kept = lines.sessionise(_log_lines(spark, sf))
    return kept.select("script_file", "pos", "line", F.col("begins").cast("int").alias("begins"), "after_pos")


@query
def assemble_log_sql(spark, sf):
    found = lines.assemble_statements(lines.sessionise(_log_lines(spark, sf)))
    return found.select("script_file", "pos", "sql_text")


@query
def assemble_queries(spark, sf):
    return statements.assemble_queries(fixture(spark, sf, "fx_script_lines"), rows=20_000)


@query
def table_statements(spark, sf):
    return statements.table_statements(fixture(spark, sf, "fx_query_lines"), rows=20_000)


@query
def split_statements(spark, sf):
    """Each line as a text of its own."""
    found = statements.split_statements(fixture(spark, sf, "fx_sql_lines").select("line"), "line")
    return found.groupBy("pos", "sql_text").agg(F.count("*").alias("n"))


@query
def split_statement_lines(spark, sf):
    return statements.split_statement_lines(_sql_lines(spark, sf), order=("pos", "line"))


@query
def statement_index(spark, sf):
    found = statements.split_statement_lines(_sql_lines(spark, sf), order=("pos", "line"))
    return statements.with_query_index(found)


# --- statements to edges --------------------------------------------------------------------------


@query
def clean_statements(spark, sf):
    cleaned = T.clean_statement(F.col("sql_text"))
    return fixture(spark, sf, "fx_statements").select(
        "script_file", "query_index", cleaned.alias("sql_query"), (T.strip(cleaned) == "").cast("int").alias("is_empty")
    )


@query
def statement_kinds(spark, sf):
    return _parsed(spark, sf).select("query_index", "kind")


@query
def table_refs(spark, sf):
    return _parsed(spark, sf).select(
        "query_index", _joined(F.col("targets")).alias("targets"), _joined(F.col("sources")).alias("sources")
    )


@query
def hard_statements(spark, sf):
    """Kind, targets and sources of statements whose expected ones come with the fixture."""
    stated = fixture(spark, sf, "fx_hard_statements").drop("kind", "targets", "sources")
    parsed = extract.parse_statements(stated)
    return parsed.select(
        "query_index", "kind", _joined(F.col("targets")).alias("targets"), _joined(F.col("sources")).alias("sources")
    )


@query
def lineage_edges_raw(spark, sf):
    return extract.extract_edges(_parsed(spark, sf), RUN).drop("is_query")


@query
def lineage_edges_query(spark, sf):
    """The sequential variant: all selects feed the run, which also depends on each table written."""
    parsed = _parsed(spark, sf)
    return extract.extract_edges(parsed, RUN, include_query_edges=True, per_script=False).drop("is_query")


@query
def lineage_errors(spark, sf):
    return extract.statement_errors(_parsed(spark, sf))


@query
def run_statistics(spark, sf):
    return reports.run_statistics(_parsed(spark, sf))


@query
def error_histogram(spark, sf):
    return reports.error_histogram(_parsed(spark, sf))


@query
def log_lineage(spark, sf):
    """Log lines to edges, with no file between."""
    found = statements.split_statement_lines(lines.sessionise(_log_lines(spark, sf)))
    return extract.extract_edges(extract.parse_statements(found), RUN).drop("is_query")


@query
def script_lineage(spark, sf):
    """Script lines to typed edges."""
    found = statements.split_statement_lines(_sql_lines(spark, sf), order=("pos", "line"))
    return lineage_edges(found, RUN, fixture(spark, sf, "fx_statement_catalog"))


# --- catalog and types ----------------------------------------------------------------------------


@query
def extend_catalog(spark, sf):
    types = fixture(spark, sf, "fx_object_types")
    return catalog.extend_catalog(types, fixture(spark, sf, "fx_view_names")).select("obj_name", "table_kind")


@query
def catalog_lookup(spark, sf):
    return catalog.catalog_lookup(fixture(spark, sf, "fx_object_types"))


def _untyped(spark, sf):
    return fixture(spark, sf, "fx_relations").drop("child_table_type", "parent_table_type")


@query
def typed_edges(spark, sf):
    types = catalog.extend_catalog(fixture(spark, sf, "fx_object_types"), fixture(spark, sf, "fx_view_names"))
    return normalise_case(catalog.add_table_types(_untyped(spark, sf), types, "rpt1"))


@query
def typed_edges_view_default(spark, sf):
    types = fixture(spark, sf, "fx_object_types")
    return normalise_case(catalog.add_table_types(_untyped(spark, sf), types, "rpt1", default="VIEW"))


@query
def typed_edges_no_catalog(spark, sf):
    return normalise_case(catalog.add_table_types(_untyped(spark, sf), None, "rpt1"))


# --- volatile tables ------------------------------------------------------------------------------


@query
def relabel_edges(spark, sf):
    return resolve.prepare_relations(fixture(spark, sf, "fx_relations"))


@query
def volatile_map(spark, sf):
    return resolve.volatile_map(resolve.prepare_relations(fixture(spark, sf, "fx_relations")))


@query
def resolve_volatile(spark, sf):
    return resolve.resolve_volatile(fixture(spark, sf, "fx_relations"))


@query
def resolve_layers(spark, sf):
    """Many full layers without a cycle."""
    return resolve.resolve_volatile(fixture(spark, sf, "fx_layers"))


@query
def resolve_cycle_chain(spark, sf):
    """Many small cycles in a row."""
    return resolve.resolve_volatile(fixture(spark, sf, "fx_cycle_chain"))


@query
def resolved_top(spark, sf):
    """The resolved edges in output order, first rows only, as the sample report shows them."""
    return resolve.sort_relations(resolve.resolve_volatile(fixture(spark, sf, "fx_relations"))).limit(10)


@query
def relations_round_trip(spark, sf):
    """Edges as they come back from the sinks: the default one, and CSV."""
    folder = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"
    edges = fixture(spark, sf, "fx_relations")
    for fmt in ("parquet", "csv"):
        write_relations(edges, f"{folder}/{fmt}-relations", fmt)
    back = [read_relations(spark, f"{folder}/{fmt}-relations").withColumn("fmt", F.lit(fmt)) for fmt in ("parquet", "csv")]
    return back[0].unionByName(back[1])


@query
def object_types_scan(spark, sf):
    """The catalog, written as CSV and scanned."""
    folder = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    fixture(spark, sf, "fx_object_types").select("obj_name", "table_kind").write.csv(folder, header=True, ignoreLeadingWhiteSpace=False)
    return read_object_types(spark, folder).select("obj_name", "table_kind")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(lines, folder, suffix):
    """Numbered lines as one text file for each script, named after it.

    One task writes a file in its order; it sorts stretches of some hundred lines, which takes far less memory than the lines.
    """
    spark = lines.sparkSession
    stretch = F.coalesce(block_of("pos", 4096), F.lit(-(1 << 63)))
    stretches = assemble_text(lines.withColumns({"stretch": stretch, "block": stretch}), ["script_file", "stretch"], "line", ("pos", "line"))
    placed = stretches.repartition("script_file").sortWithinPartitions("script_file", "stretch")
    placed.select("script_file", F.col("line").alias("value")).write.partitionBy("script_file").text(f"{folder}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/files"))
    for found in system.globStatus(path(f"{folder}/parts/script_file=*/part-*")):
        name = found.getPath().getParent().getName().partition("=")[2]
        system.rename(found.getPath(), path(f"{folder}/files/{name}{suffix}"))
    return f"{folder}/files"


@query
def scan_scripts(spark, sf):
    """Scripts as files, scanned line by line and put together again."""
    folder = _files(fixture(spark, sf, "fx_sql_lines"), _folder(spark, "scripts"), ".sql")
    placed = read_script_lines(spark, folder).withColumns({"split": F.col("block"), "stretch": block_of("pos", 64)})
    # The pieces of a file one behind the other: a whole script may not fit a row.
    return text_digest(assemble_text(placed, ["script_file", "split", "stretch"], "line"), ["script_file"], "line", ["split", "pos"])


@query
def scan_logs(spark, sf):
    """Logs as files, scanned, cleaned and cut to statements."""
    folder = _files(fixture(spark, sf, "fx_log_lines"), _folder(spark, "logs"), ".log")
    found = lines.log_statements(read_log_lines(spark, folder), FILE_KEYS)
    return found.groupBy("script_file", "sql_text").agg(F.count("*").alias("n"))


@query
def cleaned_round_trip(spark, sf):
    """Statement lines of logs as the job writes them: blank lines follow each statement."""
    folder = _folder(spark, "cleaned")
    jobs.clean_logs_job(spark, _files(fixture(spark, sf, "fx_log_lines"), folder, ".log"), f"{folder}/out")
    back = spark.read.text(f"{folder}/out")
    return back.groupBy("script_file", F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def scan_script_table(spark, sf):
    """A line table as CSV under headers of its own, which are found. An empty field is null."""
    folder = _folder(spark, "line-table")
    headers = {"script_file": "Owner", "query_name": "QueryNumber", "line": "SQL", "line_number": "LineNumber"}
    own = fixture(spark, sf, "fx_query_lines").select(*[F.col(c).alias(h) for c, h in headers.items()], F.lit("x").alias("last"))
    own.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_script_table(spark, folder, "tab")
    return back.groupBy("script_file", "query_name", F.col("line_number").cast("bigint").alias("line_number"), "line").agg(F.count("*").alias("n"))


@query
def catalog_of_files(spark, sf):
    """The catalog in two files, the long one last by name; later rows win."""
    folder = _folder(spark, "catalog-files")
    types = fixture(spark, sf, "fx_object_types")
    late = F.col("ord") > F.lit(40)
    types.repartitionByRange(2, late).sortWithinPartitions("ord").select("obj_name", "table_kind").write.csv(folder, header=True, ignoreLeadingWhiteSpace=False)
    return catalog.catalog_lookup(read_object_types(spark, folder))


@query
def errors_round_trip(spark, sf):
    """Errors as they come back from their sink, texts of several lines among them."""
    folder = _folder(spark, "errors")
    statements = fixture(spark, sf, "fx_statements")
    broken = statements.withColumn("sql_text", F.concat(F.lit("what\n \"is\", this\n"), "sql_text"))
    write_errors(extract.statement_errors(extract.parse_statements(broken)), folder)
    back = spark.read.csv(folder, header=True, multiLine=True, escape='"', schema="script_file string, query_index bigint, sql_query string, error_type string, error_info string")
    return back.select("script_file", "query_index", "sql_query", "error_type")


@query
def resolved_round_trip(spark, sf):
    """The resolver's job: relations under other headers in, sorted edges out."""
    folder = _folder(spark, "resolved")
    named = fixture(spark, sf, "fx_relations")
    named.toDF(*[c.replace("_", "").upper() for c in named.columns]).write.csv(f"{folder}/in", header=True, ignoreLeadingWhiteSpace=False)
    jobs.resolve_job(resolve.require_columns(read_relations(spark, f"{folder}/in")), f"{folder}/out")
    return read_relations(spark, f"{folder}/out")


@query
def hierarchy_round_trip(spark, sf):
    """The hierarchy's job, its flattened edges read back from CSV."""
    folder = _folder(spark, "hierarchy")
    jobs.hierarchy_job(fixture(spark, sf, "fx_hierarchy_input"), folder)
    return spark.read.csv(f"{folder}/final_output", header=True)


@query
def scan_null_keys(spark, sf):
    """A running count over groups of which one has no key."""
    found = lines.with_blocks(fixture(spark, sf, "fx_query_lines").withColumnRenamed("line_number", "pos"), 20_000)
    counted = scan_before(found.where("pos IS NOT NULL"), ["query_name"], total={"n": F.lit(1).cast("bigint")})
    return counted.groupBy("query_name").agg(F.sum("n").alias("n"), F.max("n").alias("last"))


@query
def resolution_statistics(spark, sf):
    prepared = save_point(resolve.prepare_relations(fixture(spark, sf, "fx_relations")))
    resolved = save_point(resolve.resolve_volatile(prepared, prepared=True))
    return reports.resolution_statistics(prepared, resolved)


@query
def end_to_end_lineage(spark, sf):
    """Statements to edges between non-volatile tables."""
    edges = lineage_edges(fixture(spark, sf, "fx_statements"), RUN, fixture(spark, sf, "fx_statement_catalog"))
    return resolve.resolve_volatile(edges)


# --- hierarchy ------------------------------------------------------------------------------------


@query
def hierarchy_paths(spark, sf):
    return hierarchy.build_hierarchy(fixture(spark, sf, "fx_hierarchy_input"))


@query
def hierarchy_full_joins(spark, sf):
    """The same by full outer joins, as they read."""
    return hierarchy.hierarchy_by_full_joins(fixture(spark, sf, "fx_hierarchy_input"))


@query
def hierarchy_statistics(spark, sf):
    return reports.hierarchy_statistics(fixture(spark, sf, "fx_hierarchy_input"))


@query
def hierarchy_join_statistics(spark, sf):
    return reports.join_statistics(fixture(spark, sf, "fx_hierarchy_input"))


@query
def relationship_rows(spark, sf):
    return hierarchy.relationship_rows(fixture(spark, sf, "fx_hierarchy_input"))


@query
def flatten_hierarchy(spark, sf):
    df = fixture(spark, sf, "fx_hierarchy_input")
    paths = save_point(hierarchy.build_hierarchy(df))
    return hierarchy.flatten_hierarchy(hierarchy.relationship_rows(df), paths, match_null_keys=True)


@query
def flatten_hierarchy_named_only(spark, sf):
    df = fixture(spark, sf, "fx_hierarchy_input")
    paths = save_point(hierarchy.build_hierarchy(df))
    return hierarchy.flatten_hierarchy(hierarchy.relationship_rows(df), paths, match_null_keys=False)
