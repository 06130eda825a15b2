"""Lineage edges and errors of statements.

Input: ``script_file, sql_text`` and any key columns. Every step works on one row at a time, so a
script of any size spreads over all tasks and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import references as R
from ..functions.names import qualify
from ..functions.text import clean_statement, strip

EDGE_COLUMNS = ("script_file", "child_table_name", "relationship", "parent_table_name")


def parse_statements(statements: DataFrame) -> DataFrame:
    """Add ``sql_query`` (cleaned), ``kind``, ``targets``, ``sources``, ``error_type``, ``error_info``."""
    cleaned = statements.withColumn("sql_query", clean_statement(F.col("sql_text")))
    readable = cleaned.withColumn("_text", R.readable(F.col("sql_query")))
    cut = readable.withColumns({"_opens": R.opening_kind(F.col("_text")), "_units": R.units(F.col("_text"))})
    read = cut.withColumn("_found", R.names_found(F.col("_opens"), F.col("_units")))
    placed = read.withColumn("_verb", R.verb_found(F.col("_found")))
    opens = F.when(F.col("_opens") == R.MODIFIED, "Command").otherwise(F.col("_opens"))
    kind = F.coalesce(F.col("_verb.what"), opens)
    named = placed.withColumn("kind", kind).withColumn(
        "_target", R.aliased_target(F.col("kind"), F.col("_verb.name"), F.col("_found"))
    )
    target = R.plain_name(F.coalesce("_target.name", "_verb.name"))
    parsed = named.withColumns(
        {
            "targets": F.when(target != "", F.array(target)).otherwise(F.array().cast("array<string>")),
            "sources": R.source_tables(F.col("_found"), F.col("_target")),
        }
    ).drop("_text", "_opens", "_units", "_found", "_verb", "_target")
    empty = strip(F.col("sql_query")) == ""
    unknown = F.col("kind").isNull()
    return parsed.withColumns(
        {
            "error_type": F.when(empty, "EmptyQuery").when(unknown, "UnrecognizedStatement"),
            "error_info": F.when(empty, "Empty query string").when(
                unknown, "The statement starts with no known verb"
            ),
        }
    )


def extract_edges(
    parsed: DataFrame, run_name: str, include_query_edges: bool = False, per_script: bool = True
) -> DataFrame:
    """Child, relationship, parent rows of parsed statements.

    A select feeds the pseudo table ``<run>-<script>``, or ``<run>`` if not ``per_script`` (``is_query``). Deletes and selects without a
    source give nothing; other writes without a source give a null parent.
    ``include_query_edges`` adds that the run depends on each table written.
    """
    script = F.col("script_file")
    kind = F.col("kind")
    is_query = kind == "Select"
    # No filter on errors here: pushed below the parsing it would repeat every pattern. Failed
    # statements have no kind, hence no pairs.
    query = F.concat(F.lit(run_name), F.lit("-"), script) if per_script else F.lit(run_name)
    children = F.when(is_query, F.array(query)).otherwise(
        F.transform("targets", lambda t: qualify(t, script))
    )
    no_parent = F.array(F.lit(None).cast("string"))
    needs_source = kind.isin("Select", "Delete")
    parents = F.when((F.size("sources") == 0) & ~needs_source, no_parent).otherwise(
        F.transform("sources", lambda s: qualify(s, script))
    )
    pairs = F.flatten(
        F.transform(
            children,
            lambda c: F.transform(
                parents,
                lambda p: F.struct(
                    c.alias("child"), kind.alias("relationship"), p.alias("parent"), is_query.alias("is_query")
                ),
            ),
        )
    )
    if include_query_edges:
        runs = F.transform(
            "targets",
            lambda t: F.struct(
                F.lit(run_name).alias("child"), kind.alias("relationship"),
                qualify(t, script).alias("parent"), F.lit(True).alias("is_query"),
            ),
        )
        written = ~kind.isin("Select", "Delete")
        pairs = F.concat(pairs, F.when(written, runs).otherwise(F.slice(runs, 1, 0)))
    pairs = F.when(kind.isNotNull(), pairs)
    return parsed.select("script_file", F.explode(pairs).alias("edge")).select(
        "script_file",
        F.col("edge.child").alias("child_table_name"),
        F.col("edge.relationship").alias("relationship"),
        F.col("edge.parent").alias("parent_table_name"),
        F.col("edge.is_query").alias("is_query"),
    )


def statement_errors(parsed: DataFrame) -> DataFrame:
    """Statements that failed, with cleaned text and reason; keeps ``query_index`` if present."""
    key = "query_index" if "query_index" in parsed.columns else "pos"
    columns = ("script_file", key, "sql_query", "error_type", "error_info")
    # Zero or one row per statement, for the same reason as above in place of a filter.
    error = F.when(F.col("error_type").isNotNull(), F.array(F.struct(*columns)))
    return parsed.select(F.explode(error).alias("error")).select("error.*")
