"""SQL for DuckDB that gives the same rows as the query of the same name."""

from __future__ import annotations

from tablewake.functions import text as T
from tablewake.operators.hierarchy import LEVELS, NAMES

from .fixtures import fixture_cte
from .registry import RUN

ORACLES: dict[str, str] = {}

# Patterns that read the statements of the fixtures. The engine reads tokens; nothing here comes from it.
NAME = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$#]*)'
TABLE = rf"{NAME}(?:\s*\.\s*{NAME}){{0,2}}"
ALIAS = rf"(?:\s+(?:as\s+)?{NAME})?"

LITERAL_OR_COMMENT = r"(?s)'[^']*'|--[^\n]*|/\*.*?\*/"
FROM_INSIDE_CALL = r"(?i)\bextract\s*\([^()]*\)"

# Statement kinds and the words that open them.
KINDS = {
    "Delete": r"(?i)^\s*del(?:ete)?\b",
    "Insert": r"(?i)^\s*ins(?:ert)?\b",
    "Update": r"(?i)^\s*upd(?:ate)?\b",
    "Merge": r"(?i)^\s*merge\b",
    "Create": r"(?i)^\s*(?:create|replace)\b",
    "Drop": r"(?i)^\s*drop\b",
    "Select": r"(?i)^\s*(?:(?:sel|select|with)\b|\()",
    "Command": (
        r"(?i)^\s*(?:collect|call|using|alter|exec|execute|grant|revoke|rename|comment|database|set|show|help"
        r"|explain|lock|begin|end|bt|et|commit|rollback|abort|diagnostic)\b"
    ),
}

TARGET = (
    r"(?i)^\s*(?:ins(?:ert)?\s+(?:into\s+)?|upd(?:ate)?\s+|merge\s+(?:into\s+)?|del(?:ete)?\s+(?:from\s+)?"
    r"|(?:create|replace)\s+(?:or\s+replace\s+)?(?:(?:multiset|set|volatile|global|temporary|recursive)\s+)*"
    rf"(?:table|view)\s+(?:if\s+not\s+exists\s+)?)({TABLE})"
)
SOURCE = rf"(?i)\b(?:(?:from|join)\s*\((?:\s*\()*\s*|(?:from|join|using)\s+)({TABLE})"
SOURCE_LIST = rf"(?i)\bfrom\s+({TABLE}{ALIAS}(?:\s*,\s*{TABLE}{ALIAS})+)"
COPIED = rf"(?i)^\s*(?:,[^()]*)?\bas\s+({TABLE})\s+with\s+(?:no\s+)?data\b"
FIRST_TABLE = rf"^\s*({TABLE})"
WITH_NAME = rf"(?i)(?:\bwith(?:\s+recursive)?|,)\s*({NAME})\s*(?:\([^()]*\)\s*)?as\s*\("

# Words after FROM or JOIN that open a table expression, not a table.
NOT_TABLES = ("lateral", "sel", "select", "table", "unnest", "values", "with")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLANKS = q(T.WHITESPACE)
HAS = "regexp_matches({}, {})".format


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- text and lines -------------------------------------------------------------------------------

ORACLES["split_lines"] = """
SELECT doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""

COMMENT = q(r"/\*.*?\*/")
ORACLES["strip_block_comments"] = f"""
SELECT doc_id, regexp_replace('/* ' || source || ' */ ' || text || '/* tail' || chr(10) || '*/', {COMMENT}, '', 'gs') AS text
FROM documents"""

ORACLES["strip_comment_lines"] = (
    with_ctes(fixture_cte("fx_commented"))
    + f"SELECT doc_id, regexp_replace(text, {COMMENT}, '', 'gs') AS text FROM fx_commented"
)

STRIPPED = f"trim(line, {BLANKS})"
DROPPED = f"({STRIPPED} = '' OR {HAS(STRIPPED, q(T.DROPPED_PATTERN))})"
STARTS = HAS(STRIPPED, q(T.START_PATTERN))
ENDS = f"ends_with({STRIPPED}, ';')"
ORACLES["line_classes"] = (
    with_ctes(fixture_cte("fx_log_lines"))
    + f"""SELECT script_file, pos, CAST({DROPPED} AS INT) AS is_dropped,
 CAST({HAS(STRIPPED, q(T.NOISE_PATTERN))} AS INT) AS is_log_noise,
 CAST({STARTS} AS INT) AS is_start, CAST({ENDS} AS INT) AS is_end FROM fx_log_lines"""
)

SESSIONS = f"""
flagged AS (SELECT *, {STARTS} AS s, {ENDS} AS e FROM fx_log_lines WHERE NOT {DROPPED}),
scanned AS (SELECT *,
  coalesce(last_value(CASE WHEN e THEN false WHEN s THEN true END IGNORE NULLS) OVER w, false) AS inside,
  coalesce(last_value(CASE WHEN e THEN pos END IGNORE NULLS) OVER w, -1) AS after_pos
  FROM flagged WINDOW w AS (PARTITION BY script_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sessions AS (SELECT script_file, pos, line, CAST(s AND NOT inside AS INT) AS begins, after_pos FROM scanned WHERE inside OR s),
log_sql AS (SELECT script_file, min(pos) AS pos, string_agg(line, chr(10) ORDER BY pos) AS sql_text
  FROM sessions GROUP BY script_file, after_pos)"""
ORACLES["sessionise_log"] = with_ctes(fixture_cte("fx_log_lines"), SESSIONS) + "SELECT * FROM sessions"
ORACLES["assemble_log_sql"] = with_ctes(fixture_cte("fx_log_lines"), SESSIONS) + "SELECT * FROM log_sql"

ASSEMBLED = """
queries AS (SELECT script_file, query_name, string_agg(line, chr(10) ORDER BY line_number, line) AS query_text
  FROM fx_script_lines GROUP BY ALL)"""
ORACLES["assemble_queries"] = with_ctes(fixture_cte("fx_script_lines"), ASSEMBLED) + "SELECT * FROM queries"
ORACLES["table_statements"] = (
    with_ctes(fixture_cte("fx_query_lines"))
    + f"""SELECT * FROM (
 SELECT script_file, query_name, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, trim(unnest(parts), {BLANKS}) AS sql_text
 FROM (SELECT script_file, query_name, string_split(string_agg(coalesce(line, ''), chr(10) ORDER BY line_number, coalesce(line, '')), ';') AS parts
   FROM fx_query_lines WHERE query_name IS NOT NULL GROUP BY ALL)) WHERE sql_text <> ''"""
)

ORACLES["split_statements"] = (
    with_ctes(fixture_cte("fx_sql_lines"))
    + f"""SELECT pos, sql_text, count(*) AS n FROM (
 SELECT CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, trim(unnest(parts), {BLANKS}) AS sql_text
 FROM (SELECT string_split(line, ';') AS parts FROM fx_sql_lines)) WHERE sql_text <> '' GROUP BY ALL"""
)
CUT = f"""
statements AS (SELECT * FROM (
 SELECT script_file, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, trim(unnest(parts), {BLANKS}) AS sql_text
 FROM (SELECT script_file, string_split(string_agg(line, chr(10) ORDER BY pos, line), ';') AS parts
   FROM fx_sql_lines GROUP BY script_file)) WHERE sql_text <> '')"""
ORACLES["split_statement_lines"] = with_ctes(fixture_cte("fx_sql_lines"), CUT) + "SELECT * FROM statements"
ORACLES["statement_index"] = (
    with_ctes(fixture_cte("fx_sql_lines"), CUT)
    + "SELECT *, row_number() OVER (ORDER BY script_file, pos) - 1 AS query_index FROM statements"
)

# --- statements to edges --------------------------------------------------------------------------


def clean(sql: str) -> str:
    sql = f"regexp_replace({sql}, {q(T.CARRIAGE_RETURN_CODE)}, ' ', 'g')"
    for clause in (T.LOCKING, T.NONSEQUENCED, T.SEQUENCED):
        sql = rf"regexp_replace({sql}, {q(clause)}, '\1 ')"
    return sql


def plain(name: str) -> str:
    return rf"""replace(regexp_replace({name}, '\s*\.\s*', '.', 'g'), '"', '')"""


def qualified(name: str) -> str:
    return f"CASE WHEN contains({name}, '.') THEN {name} ELSE script_file || '.' || {name} END"


KIND = "CASE " + " ".join(f"WHEN {HAS('txt', q(p))} THEN {q(k)}" for k, p in KINDS.items()) + " END"
SKIPPED = "[" + ", ".join(q(w) for w in NOT_TABLES) + "]"


def parsed(source: str) -> str:
    return f"""
cleaned AS (SELECT *, {clean("sql_text")} AS sql_query FROM {source}),
readable AS (SELECT *, regexp_replace(regexp_replace(sql_query, {q(LITERAL_OR_COMMENT)}, ' ', 'g'),
  {q(FROM_INSIDE_CALL)}, 'NULL', 'g') AS txt FROM cleaned),
placed AS (SELECT *, {KIND} AS kind, nullif({plain(f"regexp_extract(txt, {q(TARGET)}, 1)")}, '') AS target,
  regexp_replace(txt, {q(TARGET)}, ' ') AS body,
  list_concat({SKIPPED}, list_transform(regexp_extract_all(txt, {q(WITH_NAME)}, 1), lambda n: lower({plain("n")}))) AS skipped
  FROM readable),
parsed AS (SELECT *, list_filter(list_distinct(list_transform(list_concat(
    list_concat(regexp_extract_all(body, {q(SOURCE)}, 1), regexp_extract_all(body, {q(COPIED)}, 1)),
    flatten(list_transform(regexp_extract_all(body, {q(SOURCE_LIST)}, 1),
      lambda g: list_transform(string_split(g, ','), lambda i: regexp_extract(i, {q(FIRST_TABLE)}, 1))))),
    lambda n: {plain("n")})), lambda n: NOT list_contains(skipped, lower(n))) AS sources,
  CASE WHEN trim(sql_query, {BLANKS}) = '' THEN 'EmptyQuery' WHEN kind IS NULL THEN 'UnrecognizedStatement' END AS error_type,
  CASE WHEN trim(sql_query, {BLANKS}) = '' THEN 'Empty query string' WHEN kind IS NULL THEN 'The statement starts with no known verb' END AS error_info
  FROM placed),
edges AS (
 SELECT script_file, CASE WHEN kind = 'Select' THEN '{RUN}-' || script_file ELSE {qualified("target")} END AS child_table_name,
  kind AS relationship, {qualified("s")} AS parent_table_name, kind = 'Select' AS is_query
 FROM (SELECT *, unnest(sources) AS s FROM parsed WHERE error_type IS NULL) WHERE kind = 'Select' OR target IS NOT NULL
 UNION ALL
 SELECT script_file, {qualified("target")}, kind, NULL, false FROM parsed
 WHERE error_type IS NULL AND target IS NOT NULL AND len(sources) = 0 AND kind NOT IN ('Select', 'Delete'))"""


PARSED = with_ctes(fixture_cte("fx_statements"), parsed("fx_statements"))
EDGE = "script_file, child_table_name, relationship, parent_table_name"
ORACLES["clean_statements"] = (
    PARSED
    + f"SELECT script_file, query_index, sql_query, CAST(trim(sql_query, {BLANKS}) = '' AS INT) AS is_empty FROM cleaned"
)
ORACLES["statement_kinds"] = PARSED + "SELECT query_index, kind FROM placed"
ORACLES["table_refs"] = (
    PARSED
    + """SELECT query_index, coalesce(target, '') AS targets, array_to_string(list_sort(sources), ',') AS sources FROM parsed"""
)
ORACLES["hard_statements"] = (
    with_ctes(fixture_cte("fx_hard_statements")) + "SELECT query_index, kind, targets, sources FROM fx_hard_statements"
)
ORACLES["lineage_edges_raw"] = PARSED + f"SELECT {EDGE} FROM edges"
ORACLES["lineage_edges_query"] = (
    PARSED
    + f"""SELECT script_file, CASE WHEN is_query THEN '{RUN}' ELSE child_table_name END AS child_table_name, relationship, parent_table_name
FROM edges UNION ALL
SELECT script_file, '{RUN}', kind, {qualified("target")} FROM parsed
WHERE error_type IS NULL AND target IS NOT NULL AND kind NOT IN ('Select', 'Delete')"""
)
ORACLES["lineage_errors"] = (
    PARSED + "SELECT script_file, query_index, sql_query, error_type, error_info FROM parsed WHERE error_type IS NOT NULL"
)
ORACLES["run_statistics"] = (
    PARSED
    + """SELECT count(*) AS total_queries, count(*) - count(error_type) AS successful_queries, count(error_type) AS failed_queries,
 round(100.0 * (count(*) - count(error_type)) / count(*), 1) AS successful_pct,
 round(100.0 * count(error_type) / count(*), 1) AS failed_pct,
 (SELECT count(*) FROM edges) AS lineage_relationships FROM parsed"""
)
ORACLES["error_histogram"] = (
    PARSED
    + """SELECT error_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct
FROM parsed WHERE error_type IS NOT NULL GROUP BY error_type"""
)
LOG_STATEMENTS = f"""
log_statements AS (SELECT * FROM (SELECT script_file, trim(unnest(string_split(sql_text, ';')), {BLANKS}) AS sql_text FROM log_sql)
  WHERE sql_text <> '')"""
ORACLES["log_lineage"] = (
    with_ctes(fixture_cte("fx_log_lines"), SESSIONS, LOG_STATEMENTS, parsed("log_statements")) + f"SELECT {EDGE} FROM edges"
)

# --- catalog and types ----------------------------------------------------------------------------


def key(name: str) -> str:
    return f"upper(trim({name}, {BLANKS}))"


def lookup(types: str) -> str:
    return f"""
lookup AS (SELECT {key("obj_name")} AS key, arg_max(trim(table_kind, {BLANKS}), ord) AS table_kind FROM {types} GROUP BY ALL)"""


def typed(edges: str, default: str, run: str) -> str:
    """``edges`` has ``is_query``."""

    def kind(alias: str) -> str:
        return f"CASE {alias}.table_kind WHEN 'V' THEN 'VIEW' WHEN 'T' THEN 'TABLE' ELSE '{default}' END"

    return f"""
typed AS (SELECT upper(e.script_file) AS script_file, upper(child_table_name) AS child_table_name,
 upper(relationship) AS relationship, upper(parent_table_name) AS parent_table_name,
 CASE WHEN is_query OR upper(child_table_name) = upper('{run}') THEN 'UNKNOWN' WHEN child_table_name IS NOT NULL THEN {kind("c")} END AS child_table_type,
 CASE WHEN parent_table_name IS NOT NULL THEN {kind("p")} END AS parent_table_type
 FROM {edges} e LEFT JOIN lookup c ON {key("child_table_name")} = c.key LEFT JOIN lookup p ON {key("parent_table_name")} = p.key)"""


EXTENDED = f"""
added AS (SELECT DISTINCT trim(view_name, {BLANKS}) AS obj_name FROM fx_view_names WHERE view_name IS NOT NULL
  AND {key("view_name")} NOT IN (SELECT {key("obj_name")} FROM fx_object_types)),
extended AS (SELECT obj_name, table_kind, ord FROM fx_object_types UNION ALL SELECT obj_name, 'V', 9223372036854775807 FROM added)"""
UNTYPED = "untyped AS (SELECT *, false AS is_query FROM fx_relations)"
ORACLES["extend_catalog"] = (
    with_ctes(fixture_cte("fx_object_types", "fx_view_names"), EXTENDED) + "SELECT obj_name, table_kind FROM extended"
)
ORACLES["catalog_lookup"] = with_ctes(fixture_cte("fx_object_types"), lookup("fx_object_types")) + "SELECT * FROM lookup"
ORACLES["typed_edges"] = (
    with_ctes(
        fixture_cte("fx_object_types", "fx_view_names", "fx_relations"),
        EXTENDED, lookup("extended"), UNTYPED, typed("untyped", "VOLTABLE", "rpt1"),
    )
    + "SELECT * FROM typed"
)
ORACLES["typed_edges_view_default"] = (
    with_ctes(
        fixture_cte("fx_object_types", "fx_relations"),
        lookup("fx_object_types"), UNTYPED, typed("untyped", "VIEW", "rpt1"),
    )
    + "SELECT * FROM typed"
)
ORACLES["typed_edges_no_catalog"] = (
    with_ctes(fixture_cte("fx_relations"))
    + """SELECT upper(script_file) AS script_file, upper(child_table_name) AS child_table_name, upper(relationship) AS relationship,
 upper(parent_table_name) AS parent_table_name, CASE WHEN child_table_name = 'RPT1' THEN 'UNKNOWN' ELSE 'VIEW' END AS child_table_type,
 'VIEW' AS parent_table_type FROM fx_relations"""
)
SCRIPT_EDGES = [
    fixture_cte("fx_sql_lines", "fx_statement_catalog"),
    CUT,
    parsed("statements"),
    lookup("fx_statement_catalog"),
    typed("edges", "VOLTABLE", RUN),
]
ORACLES["script_lineage"] = with_ctes(*SCRIPT_EDGES) + "SELECT * FROM typed"

# --- volatile tables ------------------------------------------------------------------------------


def prepared(relations: str) -> str:
    columns = ("script_file", "child_table_name", "parent_table_name", "child_table_type", "parent_table_type")
    trimmed = ", ".join(f"trim({c}, {BLANKS}) AS {c}" for c in columns)
    return f"""
prepared AS (SELECT {trimmed}, CASE WHEN upper(trim(relationship, {BLANKS})) = 'DELETE' THEN 'DELETE' ELSE 'Loaded From' END AS relationship
  FROM (SELECT DISTINCT * FROM {relations}))"""


RESOLVED = """
defs AS (SELECT DISTINCT child_table_name AS v, parent_table_name AS p, parent_table_type AS t, script_file AS s
  FROM prepared WHERE child_table_type = 'VOLTABLE' AND child_table_name IS NOT NULL),
walk AS (
  SELECT child_table_name AS c, child_table_type AS ct, relationship AS r, parent_table_name AS cur, 'VOLTABLE' AS t,
    [parent_table_name] AS path, [script_file] AS trail
  FROM prepared WHERE child_table_type IS DISTINCT FROM 'VOLTABLE' AND parent_table_type = 'VOLTABLE' AND parent_table_name IS NOT NULL
  UNION
  SELECT c, ct, r, d.p, d.t, list_sort(list_append(path, d.p)), list_sort(list_distinct(list_append(trail, d.s)))
  FROM walk JOIN defs d ON d.v = walk.cur
  WHERE walk.t = 'VOLTABLE' AND NOT coalesce(list_contains(path, d.p), false)),
resolved AS (
  SELECT DISTINCT script_file, child_table_name, relationship, parent_table_name, child_table_type, parent_table_type
  FROM prepared WHERE child_table_type IS DISTINCT FROM 'VOLTABLE' AND parent_table_type IS DISTINCT FROM 'VOLTABLE'
  UNION
  SELECT array_to_string(trail, ' | '), c, r, cur, ct, t FROM walk WHERE t IS DISTINCT FROM 'VOLTABLE')"""


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


RELATIONS = [fixture_cte("fx_relations"), prepared("fx_relations")]
ORACLES["relabel_edges"] = with_ctes(*RELATIONS) + "SELECT * FROM prepared"
ORACLES["volatile_map"] = (
    with_ctes(*RELATIONS)
    + """SELECT DISTINCT child_table_name AS volatile_table, parent_table_name, parent_table_type, script_file
FROM prepared WHERE child_table_type = 'VOLTABLE'"""
)
ORACLES["resolve_volatile"] = recursive(*RELATIONS, RESOLVED) + "SELECT * FROM resolved"
ORACLES["resolved_top"] = (
    recursive(*RELATIONS, RESOLVED)
    + """SELECT * FROM resolved ORDER BY child_table_name NULLS LAST, parent_table_name NULLS LAST, script_file NULLS LAST,
 relationship NULLS LAST, child_table_type NULLS LAST, parent_table_type NULLS LAST LIMIT 10"""
)
ORACLES["resolution_statistics"] = (
    recursive(*RELATIONS, RESOLVED)
    + """SELECT 'input_relationships' AS metric, CAST(NULL AS VARCHAR) AS table_type, count(*) AS n FROM prepared
UNION ALL SELECT 'output_relationships', NULL, count(*) FROM resolved
UNION ALL SELECT 'relationships_removed', NULL, count(*) FROM prepared WHERE child_table_type = 'VOLTABLE'
UNION ALL SELECT 'net_change', NULL, (SELECT count(*) FROM resolved) - (SELECT count(*) FROM prepared)
UNION ALL SELECT 'volatile_tables', NULL, count(DISTINCT child_table_name) FROM prepared WHERE child_table_type = 'VOLTABLE'
UNION ALL SELECT 'input_type', child_table_type, count(*) FROM prepared WHERE child_table_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'output_type', child_table_type, count(*) FROM resolved WHERE child_table_type IS NOT NULL GROUP BY 2"""
)
ORACLES["end_to_end_lineage"] = (
    recursive(
        fixture_cte("fx_statements", "fx_statement_catalog"),
        parsed("fx_statements"),
        lookup("fx_statement_catalog"),
        typed("edges", "VOLTABLE", RUN),
        prepared("typed"),
        RESOLVED,
    )
    + "SELECT * FROM resolved"
)

# --- hierarchy ------------------------------------------------------------------------------------


def hierarchy_steps(last: int = len(LEVELS) - 1) -> str:
    steps = []
    for depth, name in enumerate(LEVELS):
        steps.append(
            f'l{depth} AS (SELECT parent_table_name AS "{name}", child_table_name AS "{NAMES[depth + 1]}" '
            f"FROM fx_hierarchy_input WHERE parent_table_type = '{name}')"
        )
    steps.append("h0 AS (SELECT * FROM l0)")
    for depth in range(1, last + 1):
        shared = LEVELS[depth]
        above = ", ".join(f'a."{n}"' for n in NAMES[:depth])
        steps.append(
            f'h{depth} AS (SELECT {above}, coalesce(a."{shared}", b."{shared}") AS "{shared}", b."{NAMES[depth + 1]}" '
            f'FROM h{depth - 1} a FULL JOIN l{depth} b ON a."{shared}" IS NOT DISTINCT FROM b."{shared}")'
        )
    return ",\n".join(steps)


HIERARCHY = [fixture_cte("fx_hierarchy_input"), hierarchy_steps()]
IS_LEVEL = "coalesce(parent_table_type IN (" + ", ".join(q(n) for n in LEVELS) + "), false)"
RELATIONSHIPS = f"""
rel AS (SELECT parent_table_name AS "ParentObjectName", relationship AS "InternalRelationship",
  child_table_name AS "ChildObjectName" FROM fx_hierarchy_input WHERE NOT {IS_LEVEL})"""
ORACLES["hierarchy_paths"] = with_ctes(*HIERARCHY) + "SELECT * FROM h7"
ORACLES["hierarchy_full_joins"] = ORACLES["hierarchy_paths"]
ORACLES["hierarchy_statistics"] = (
    with_ctes(fixture_cte("fx_hierarchy_input"))
    + f"""SELECT CASE WHEN {IS_LEVEL} THEN parent_table_type ELSE 'Relationship' END AS level, count(*) AS n
FROM fx_hierarchy_input GROUP BY 1"""
)
ORACLES["hierarchy_join_statistics"] = with_ctes(*HIERARCHY) + "\nUNION ALL ".join(
    f"SELECT '{LEVELS[d]}' AS joined_on, count(*) AS n FROM h{d}" for d in range(1, len(LEVELS))
)
ORACLES["relationship_rows"] = with_ctes(fixture_cte("fx_hierarchy_input"), RELATIONSHIPS) + "SELECT * FROM rel"


def flattened(meet: str) -> str:
    owned = ", ".join(
        f'{alias}."{name}" AS "{side}{name}"'
        for alias, side in (("p", "Parent"), ("c", "Child"))
        for name in LEVELS
    )
    return (
        with_ctes(*HIERARCHY, RELATIONSHIPS)
        + f"""SELECT {owned}, "ParentObjectName", "InternalRelationship", "ChildObjectName"
FROM rel LEFT JOIN h7 p ON "ParentObjectName" {meet} p."ObjectName" LEFT JOIN h7 c ON "ChildObjectName" {meet} c."ObjectName\""""
    )


ORACLES["flatten_hierarchy"] = flattened("IS NOT DISTINCT FROM")
ORACLES["flatten_hierarchy_named_only"] = flattened("=")


# The tables of a layer, or of a pair, lead to the next with the same scripts: distinct tables and scripts, no paths.
REACHED = """WITH RECURSIVE {cte},
walk AS (
 SELECT child_table_name AS report, parent_table_name AS name, [script_file] AS scripts FROM {name} WHERE child_table_type = 'TABLE'
 UNION
 SELECT report, parent_table_name, list_sort(list_distinct(list_append(scripts, script_file)))
 FROM walk JOIN {name} ON child_table_name = name)
SELECT array_to_string(scripts, ' | ') AS script_file, report AS child_table_name, 'Loaded From' AS relationship, name AS parent_table_name,
 'TABLE' AS child_table_type, 'TABLE' AS parent_table_type FROM walk WHERE starts_with(name, 'TB')"""
ORACLES["resolve_layers"] = REACHED.format(cte=fixture_cte("fx_layers"), name="fx_layers")
ORACLES["resolve_cycle_chain"] = REACHED.format(cte=fixture_cte("fx_cycle_chain"), name="fx_cycle_chain")
ORACLES["relations_round_trip"] = (
    with_ctes(fixture_cte("fx_relations"))
    + "SELECT *, 'parquet' AS fmt FROM fx_relations UNION ALL SELECT *, 'csv' FROM fx_relations"
)
ORACLES["object_types_scan"] = with_ctes(fixture_cte("fx_object_types")) + "SELECT obj_name, table_kind FROM fx_object_types"

# --- scans and sinks ------------------------------------------------------------------------------

ORACLES["scan_scripts"] = (
    with_ctes(fixture_cte("fx_sql_lines"))
    + """SELECT script_file, length(text) AS n_chars, sha256(text) AS sha
FROM (SELECT script_file, string_agg(line, chr(10) ORDER BY pos, line) AS text FROM fx_sql_lines GROUP BY script_file)"""
)
ORACLES["scan_logs"] = (
    with_ctes(fixture_cte("fx_log_lines"), SESSIONS) + "SELECT script_file, sql_text, count(*) AS n FROM log_sql GROUP BY ALL"
)
ORACLES["cleaned_round_trip"] = (
    with_ctes(fixture_cte("fx_log_lines"), SESSIONS)
    + f"""SELECT script_file, line, count(*) AS n FROM (SELECT script_file, line FROM sessions
 UNION ALL SELECT script_file, unnest(['', '']) FROM sessions WHERE {ENDS}) GROUP BY ALL"""
)
ORACLES["scan_script_table"] = (
    with_ctes(fixture_cte("fx_query_lines"))
    + "SELECT 'tab' AS script_file, query_name, CAST(line_number AS BIGINT) AS line_number, nullif(line, '') AS line, count(*) AS n FROM fx_query_lines GROUP BY ALL"
)
ORACLES["catalog_of_files"] = ORACLES["catalog_lookup"]
BROKEN = """'what' || chr(10) || ' "is", this' || chr(10) || sql_text"""
ORACLES["errors_round_trip"] = (
    with_ctes(fixture_cte("fx_statements"))
    + f"SELECT script_file, query_index, {clean(BROKEN)} AS sql_query, 'UnrecognizedStatement' AS error_type FROM fx_statements"
)
ORACLES["resolved_round_trip"] = ORACLES["resolve_volatile"]
ORACLES["hierarchy_round_trip"] = ORACLES["flatten_hierarchy_named_only"]
ORACLES["scan_null_keys"] = (
    with_ctes(fixture_cte("fx_query_lines"))
    + """SELECT query_name, CAST(sum(n) AS BIGINT) AS n, max(n) AS last
FROM (SELECT coalesce(query_name, '') AS query_name, row_number() OVER (PARTITION BY coalesce(query_name, '') ORDER BY line_number) - 1 AS n FROM fx_query_lines)
GROUP BY query_name"""
)
