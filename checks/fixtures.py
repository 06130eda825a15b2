"""Inputs for the queries, derived from whole driver tables.

One SQL text per fixture runs in both engines; ``{orders}`` and the like stand for the driver tables.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from tablewake.session import spread, spread_evenly

LONG_TABLES = ("documents", "events", "lineitem")
#: Each row becomes a statement to parse.
STATEMENT_TABLES = ("orders",)

FIXTURES = {
    # Statements of every kind, with clauses to remove, literals, comments and empty ones.
    "fx_statements": """
SELECT 'scr_' || CAST(o_custkey % 30 AS STRING) AS script_file, o_orderkey AS query_index,
 CASE CAST(o_orderkey % 15 AS INT)
  WHEN 0 THEN 'INSERT INTO stg.t' || CAST(o_custkey % 40 AS STRING) || ' SELECT a FROM src.s' || CAST(o_orderkey % 55 AS STRING) || ' JOIN vt' || CAST(o_custkey % 9 AS STRING) || ' ON 1=1'
  WHEN 1 THEN 'SEL * FROM a' || CAST(o_custkey % 20 AS STRING) || ' x, b.c' || CAST(o_orderkey % 20 AS STRING) || ' y WHERE 1=1'
  WHEN 2 THEN 'WITH q AS (SELECT * FROM db.z' || CAST(o_custkey % 15 AS STRING) || ') SELECT * FROM Q LEFT JOIN w.v' || CAST(o_orderkey % 10 AS STRING) || ' ON 2=2'
  WHEN 3 THEN 'CREATE MULTISET VOLATILE TABLE vt' || CAST(o_custkey % 9 AS STRING) || ' AS (SELECT EXTRACT(YEAR FROM dt) y FROM p.q' || CAST(o_orderkey % 12 AS STRING) || ') WITH DATA'
  WHEN 4 THEN 'REPLACE VIEW sem."My V' || CAST(o_custkey % 6 AS STRING) || '" AS LOCKING ROW FOR ACCESS SELECT ''x from y'' c FROM b . c' || CAST(o_orderkey % 8 AS STRING)
  WHEN 5 THEN 'DELETE FROM db.t' || CAST(o_custkey % 11 AS STRING) || ' WHERE k IN (SELECT k FROM db.t' || CAST(o_orderkey % 13 AS STRING) || ')'
  WHEN 6 THEN 'DEL db.t' || CAST(o_custkey % 11 AS STRING) || ' ALL'
  WHEN 7 THEN 'MERGE INTO m.t' || CAST(o_custkey % 5 AS STRING) || ' USING m.s' || CAST(o_orderkey % 5 AS STRING) || ' ON 1=1 WHEN MATCHED THEN UPDATE SET a=1'
  WHEN 8 THEN 'NONSEQUENCED VALIDTIME AND NONSEQUENCED TRANSACTIONTIME UPDATE t' || CAST(o_custkey % 7 AS STRING) || ' FROM a.b' || CAST(o_orderkey % 7 AS STRING) || ' x SET c=1'
  WHEN 9 THEN 'INSERT INTO t' || CAST(o_custkey % 7 AS STRING) || '_x000D_ VALUES (1)'
  WHEN 10 THEN '_x000d_  '
  WHEN 11 THEN 'COLLECT STATISTICS ON t' || CAST(o_custkey % 7 AS STRING)
  WHEN 12 THEN '/* from c.d */ ( SELECT a FROM x' || CAST(o_custkey % 4 AS STRING) || ' -- join y' || chr(10) || ') UNION (SEL b FROM e.f' || CAST(o_orderkey % 3 AS STRING) || ')'
  WHEN 13 THEN CASE WHEN o_custkey % 2 = 0 THEN 'hello table ' || CAST(o_custkey AS STRING) ELSE 'create table cp' || CAST(o_custkey % 9 AS STRING) || ' as db.t' || CAST(o_orderkey % 9 AS STRING) || ' with data' END
  ELSE 'INSERT INTO vt' || CAST(o_custkey % 9 AS STRING) || ' SELECT * FROM src.s' || CAST(o_orderkey % 55 AS STRING) || ', vt' || CAST(o_custkey % 8 AS STRING) END AS sql_text
FROM {orders}
""",
    # Statements that patterns read wrongly, with what they are, write and read (sorted) beside them.
    "fx_hard_statements": """
SELECT 'scr_' || CAST(o_custkey % 30 AS STRING) AS script_file, o_orderkey AS query_index,
 CASE CAST(o_orderkey % 17 AS INT)
  WHEN 0 THEN 'UPDATE tgt FROM db.real' || CAST(o_custkey % 40 AS STRING) || ' tgt, db.src s SET a = s.a, b = 2'
  WHEN 1 THEN 'DELETE a FROM db.t' || CAST(o_custkey % 40 AS STRING) || ' a, db.t2 b WHERE a.k = b.k'
  WHEN 2 THEN 'SELECT * FROM (SEL x FROM a.b) q, d.e' || CAST(o_custkey % 40 AS STRING) || ' f, g.h'
  WHEN 3 THEN 'SELECT 1 FROM b.c q LEFT JOIN d.e f ON q.x = f(q.y, 1), g.h' || CAST(o_custkey % 40 AS STRING) || ' i'
  WHEN 4 THEN 'SEL 1 FROM a.b' || CAST(o_custkey % 40 AS STRING) || ' WHERE c IS NOT DISTINCT FROM d AND e IS DISTINCT FROM f'
  WHEN 5 THEN 'SELECT "it''s" FROM a.b' || CAST(o_custkey % 40 AS STRING) || ' WHERE c = ''x from z'''
  WHEN 6 THEN 'INSERT INTO tëst.ü SELECT * FROM Été.t' || CAST(o_custkey % 40 AS STRING) || ', Straße.x'
  WHEN 7 THEN 'INSERT INTO s.a.b.c SELECT * FROM w.x.y.z' || CAST(o_custkey % 40 AS STRING)
  WHEN 8 THEN 'USING (k INT, d DECIMAL(10,2)) INSERT INTO a.b' || CAST(o_custkey % 40 AS STRING) || ' SELECT :k FROM c.d'
  WHEN 9 THEN 'LOCKING TABLE b.c FOR WRITE INSERT INTO b.c SELECT * FROM d.e' || CAST(o_custkey % 40 AS STRING)
  WHEN 10 THEN 'SEL EXTRACT(YEAR FROM CAST(COALESCE(TRIM(SUBSTR(x,(1+1),3)),(SEL MAX(y) FROM m.n)) AS DATE)) FROM a.t' || CAST(o_custkey % 40 AS STRING)
  WHEN 11 THEN 'USING (k INT, d DECIMAL(10,2), p f(g(h(1)))) LOCKING TABLE q FOR READ INSERT INTO a.b' || CAST(o_custkey % 40 AS STRING) || ' SELECT * FROM c.d'
  WHEN 12 THEN 'CREATE JOIN INDEX a.j' || CAST(o_custkey % 40 AS STRING) || ' AS SELECT * FROM c.d'
  WHEN 13 THEN 'CREATE GLOBAL TEMPORARY TRACE TABLE a.tr' || CAST(o_custkey % 40 AS STRING) || ' (x INT)'
  WHEN 14 THEN 'WITH q (a DECIMAL(10,2), "c(") AS (SELECT * FROM t.u), r (d) AS (SEL * FROM q) SELECT * FROM r, z.z' || CAST(o_custkey % 40 AS STRING)
  WHEN 15 THEN 'CREATE TABLE a.b, FALLBACK, MAP (m(1)) AS c.d' || CAST(o_custkey % 40 AS STRING) || ' WITH NO DATA'
  ELSE 'SELECT * FROM TABLE (f(x)) AS t, ((u.v' || CAST(o_custkey % 40 AS STRING) || ' JOIN w.x ON 1=1))' END AS sql_text,
 CASE WHEN o_orderkey % 17 = 0 THEN 'Update' WHEN o_orderkey % 17 = 1 THEN 'Delete' WHEN o_orderkey % 17 IN (6, 7, 8, 9, 11) THEN 'Insert' WHEN o_orderkey % 17 IN (12, 13, 15) THEN 'Create' ELSE 'Select' END AS kind,
 CASE CAST(o_orderkey % 17 AS INT) WHEN 0 THEN 'db.real' || CAST(o_custkey % 40 AS STRING) WHEN 1 THEN 'db.t' || CAST(o_custkey % 40 AS STRING)
  WHEN 6 THEN 'tëst.ü' WHEN 7 THEN 's.a.b.c' WHEN 8 THEN 'a.b' || CAST(o_custkey % 40 AS STRING) WHEN 9 THEN 'b.c'
  WHEN 11 THEN 'a.b' || CAST(o_custkey % 40 AS STRING) WHEN 12 THEN 'a.j' || CAST(o_custkey % 40 AS STRING) WHEN 13 THEN 'a.tr' || CAST(o_custkey % 40 AS STRING)
  WHEN 15 THEN 'a.b' ELSE '' END AS targets,
 CASE CAST(o_orderkey % 17 AS INT) WHEN 0 THEN 'db.src' WHEN 1 THEN 'db.t2' WHEN 2 THEN 'a.b,d.e' || CAST(o_custkey % 40 AS STRING) || ',g.h'
  WHEN 3 THEN 'b.c,d.e,g.h' || CAST(o_custkey % 40 AS STRING) WHEN 4 THEN 'a.b' || CAST(o_custkey % 40 AS STRING) WHEN 5 THEN 'a.b' || CAST(o_custkey % 40 AS STRING)
  WHEN 6 THEN 'Straße.x,Été.t' || CAST(o_custkey % 40 AS STRING) WHEN 7 THEN 'w.x.y.z' || CAST(o_custkey % 40 AS STRING) WHEN 8 THEN 'c.d'
  WHEN 9 THEN 'd.e' || CAST(o_custkey % 40 AS STRING) WHEN 10 THEN 'a.t' || CAST(o_custkey % 40 AS STRING) || ',m.n'
  WHEN 11 THEN 'c.d' WHEN 12 THEN 'c.d' WHEN 13 THEN '' WHEN 14 THEN 't.u,z.z' || CAST(o_custkey % 40 AS STRING) WHEN 15 THEN 'c.d' || CAST(o_custkey % 40 AS STRING)
  ELSE 'u.v' || CAST(o_custkey % 40 AS STRING) || ',w.x' END AS sources
FROM {orders}
""",
    # Forty full layers of three volatile tables for each part size, and a report on each first one.
    "fx_layers": """
SELECT 'scr_' || CAST(g % 2 AS STRING) AS script_file, 'L' || CAST(g AS STRING) || '_' || CAST(d AS STRING) || '_' || CAST(i AS STRING) AS child_table_name, 'INSERT' AS relationship,
 CASE WHEN d = 39 THEN 'TB' || CAST(g AS STRING) ELSE 'L' || CAST(g AS STRING) || '_' || CAST(d + 1 AS STRING) || '_' || CAST(j AS STRING) END AS parent_table_name,
 'VOLTABLE' AS child_table_type, CASE WHEN d = 39 THEN 'TABLE' ELSE 'VOLTABLE' END AS parent_table_type
FROM (SELECT DISTINCT p_size AS g FROM {part}), (SELECT DISTINCT p_partkey % 40 AS d FROM {part}),
 (SELECT DISTINCT r_regionkey % 3 AS i FROM {region}), (SELECT DISTINCT r_regionkey % 3 AS j FROM {region})
UNION ALL SELECT DISTINCT 'rpt', 'RPT' || CAST(p_size AS STRING), 'INSERT', 'L' || CAST(p_size AS STRING) || '_0_0', 'TABLE', 'VOLTABLE' FROM {part}
""",
    # Thirty pairs of volatile tables that load each other, each pair loading the next, likewise.
    "fx_cycle_chain": """
SELECT 'scr_0' AS script_file, a || CAST(g AS STRING) || '_' || CAST(d AS STRING) AS child_table_name, 'INSERT' AS relationship,
 CASE WHEN step = 0 THEN CASE WHEN a = 'A' THEN 'B' ELSE 'A' END || CAST(g AS STRING) || '_' || CAST(d AS STRING)
  WHEN d = 29 THEN 'TB' || CAST(g AS STRING) ELSE 'A' || CAST(g AS STRING) || '_' || CAST(d + 1 AS STRING) END AS parent_table_name,
 'VOLTABLE' AS child_table_type, CASE WHEN step = 1 AND d = 29 THEN 'TABLE' ELSE 'VOLTABLE' END AS parent_table_type
FROM (SELECT DISTINCT p_size AS g FROM {part}), (SELECT DISTINCT p_partkey % 30 AS d FROM {part}),
 (SELECT DISTINCT r_regionkey % 2 AS step FROM {region}), (SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS a FROM {region})
UNION ALL SELECT DISTINCT 'rpt', 'RPT' || CAST(p_size AS STRING), 'INSERT', 'A' || CAST(p_size AS STRING) || '_0', 'TABLE', 'VOLTABLE' FROM {part}
""",
    # Catalog of the named schemas of fx_statements; what it lacks is volatile.
    "fx_statement_catalog": """
SELECT DISTINCT ' stg.T' || CAST(o_custkey % 40 AS STRING) AS obj_name, 'T' AS table_kind, o_custkey % 40 AS ord FROM {orders}
UNION ALL SELECT DISTINCT 'SRC.s' || CAST(o_orderkey % 55 AS STRING), CASE WHEN o_orderkey % 55 % 2 = 0 THEN 'T' ELSE 'V' END, o_orderkey % 55 FROM {orders}
UNION ALL SELECT DISTINCT 'p.q' || CAST(o_orderkey % 12 AS STRING), 'T', o_orderkey % 12 FROM {orders}
""",
    # Console output around statements.
    "fx_log_lines": """
SELECT 'log_' || CAST(user_id % 20 AS STRING) AS script_file, event_id AS pos,
 CASE CAST(event_id * 7 % 13 AS INT)
  WHEN 0 THEN 'SELECT a' WHEN 1 THEN 'INSERT INTO t' WHEN 2 THEN '  FROM x' || CAST(event_id % 50 AS STRING) || ';'
  WHEN 3 THEN 'noise' WHEN 4 THEN 'SEL 1;' WHEN 5 THEN '-- c' WHEN 6 THEN '*** ok' WHEN 7 THEN '.QUIT'
  WHEN 8 THEN '' WHEN 9 THEN '  WITH DATA;' WHEN 10 THEN ' 12 rows found' WHEN 11 THEN 'update z set q=1;'
  ELSE 'Total elapsed time was 1 second.' END AS line
FROM {events}
""",
    # Lines of named queries.
    "fx_script_lines": """
SELECT 'scr_' || CAST(l_suppkey % 10 AS STRING) AS script_file, 'q' || CAST(l_orderkey % 500 AS STRING) AS query_name,
 l_orderkey * 10 + l_linenumber AS line_number, 'col_' || CAST(l_partkey AS STRING) AS line, l_partkey AS tie
FROM {lineitem}
""",
    # Lines of SQL with semicolons anywhere; one line in three belongs to one script.
    "fx_sql_lines": """
SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'scr_hot' ELSE 'scr_' || CAST(l_suppkey % 10 AS STRING) END AS script_file,
 l_orderkey * 10 + l_linenumber AS pos,
 CASE CAST(l_partkey % 8 AS INT)
  WHEN 0 THEN 'INSERT INTO stg.t' || CAST(l_partkey % 50 AS STRING)
  WHEN 1 THEN '  SELECT a FROM src.s' || CAST(l_partkey % 70 AS STRING)
  WHEN 2 THEN '; DELETE FROM db.t' || CAST(l_partkey % 9 AS STRING) || ' WHERE k IN (SELECT k FROM db.u' || CAST(l_orderkey % 9 AS STRING) || ');'
  WHEN 3 THEN 'JOIN w.v' || CAST(l_partkey % 30 AS STRING) || ' ON 1=1'
  WHEN 4 THEN '  ;'
  WHEN 5 THEN 'SEL 1; SEL x FROM p.q' || CAST(l_orderkey % 20 AS STRING)
  WHEN 6 THEN ''
  ELSE ';' END AS line
FROM {lineitem}
""",
    # The same as a line table of named queries; some lines have no name.
    "fx_query_lines": """
SELECT 'tab_' || CAST(l_suppkey % 4 AS STRING) AS script_file,
 CASE WHEN l_partkey % 19 = 0 THEN CAST(NULL AS STRING) WHEN l_suppkey % 3 = 0 THEN 'hot' ELSE 'q' || CAST(l_orderkey % 300 AS STRING) END AS query_name,
 l_orderkey * 10 + l_linenumber AS line_number,
 CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'SELECT a' || CAST(l_partkey AS STRING) WHEN 1 THEN ' FROM b;' WHEN 2 THEN 'x;y' WHEN 3 THEN ';' WHEN 4 THEN '' ELSE CAST(NULL AS STRING) END AS line
FROM {lineitem}
""",
    # Documents with comment marks for some of the punctuation: comments over lines, unclosed ones, stray ends.
    "fx_commented": """
SELECT doc_id, replace(replace(replace(text, ', ', ' /* '), '. ', ' */ '), '.' || chr(10), '/*/' || chr(10)) AS text FROM {documents}
""",
    "fx_object_types": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN ' tb' ELSE 'TB' END || CAST(p_partkey % 97 AS STRING) AS obj_name,
 CASE WHEN p_size % 3 = 0 THEN 'V' WHEN p_size % 3 = 1 THEN 'T' ELSE 'O' END AS table_kind, p_partkey AS ord
FROM {part}
""",
    "fx_view_names": """
SELECT CASE WHEN s_suppkey % 10 = 0 THEN CAST(NULL AS STRING) ELSE ' tb' || CAST(s_suppkey * 3 AS STRING) || ' ' END AS view_name FROM {supplier}
""",
    # Volatile tables in pairs that load each other, pairs chained to earlier pairs, and reports on them;
    # one report in three reads the same volatile table.
    "fx_relations": """
SELECT 'scr_' || CAST(p_partkey % 40 AS STRING) AS script_file, 'VT' || CAST(p_partkey AS STRING) AS child_table_name,
 CASE WHEN p_size % 5 = 0 THEN 'DELETE' ELSE 'INSERT' END AS relationship,
 'VT' || CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey - 1 END AS STRING) AS parent_table_name,
 'VOLTABLE' AS child_table_type, 'VOLTABLE' AS parent_table_type
FROM {part}
UNION ALL
SELECT 'scr_' || CAST(p_partkey % 7 AS STRING), ' VT' || CAST(p_partkey AS STRING), 'INSERT',
 CASE WHEN p_partkey % 2 = 0 THEN 'VT' || CAST(CAST(FLOOR(p_partkey / 3) AS BIGINT) AS STRING) ELSE 'TB' || CAST(p_partkey % 97 AS STRING) END,
 'VOLTABLE', CASE WHEN p_partkey % 2 = 0 THEN 'VOLTABLE' ELSE 'TABLE' END
FROM {part}
UNION ALL
SELECT 'scr_s' || CAST(c_custkey % 7 AS STRING), 'RPT' || CAST(c_custkey AS STRING),
 CASE WHEN c_custkey % 4 = 0 THEN 'Delete' ELSE 'INSERT' END,
 CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 5 = 0 THEN 'TB' || CAST(c_custkey AS STRING)
  WHEN c_custkey % 17 = 0 THEN 'VX' || CAST(c_custkey AS STRING) WHEN c_custkey % 3 = 0 THEN 'VT7' ELSE 'VT' || CAST(c_custkey AS STRING) END,
 CASE WHEN c_custkey % 2 = 0 THEN 'TABLE' ELSE 'VIEW' END,
 CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 5 = 0 THEN 'TABLE' ELSE 'VOLTABLE' END
FROM {customer}
""",
    # Eight ownership levels with rows unmatched on either side, null parents and null children at several levels, one schema that
    # owns a third of all objects, and relationships between objects.
    "fx_hierarchy_input": """
SELECT n_name AS child_table_name, 'in' AS relationship, r_name AS parent_table_name, 'Sector' AS parent_table_type
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, 'in', CASE WHEN n_nationkey % 6 = 0 THEN 'NO ' || n_name ELSE n_name END, 'Application'
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 'CL' || CAST(c_custkey AS STRING), 'in', n_name || '/' || CASE WHEN c_custkey % 50 = 0 THEN 'LOST' ELSE c_mktsegment END, 'Purpose'
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 'TL' || CAST(c_custkey AS STRING), 'in', 'CL' || CAST(CAST(FLOOR(c_custkey / 2) AS BIGINT) AS STRING), 'Client' FROM {customer}
UNION ALL SELECT 'SY' || CAST(p_partkey AS STRING), 'in', 'TL' || CAST(p_partkey AS STRING), 'Tool' FROM {part}
UNION ALL SELECT 'ID' || CAST(p_partkey AS STRING), 'in', 'SY' || CAST(p_partkey * 2 AS STRING), 'System' FROM {part}
UNION ALL SELECT 'SC' || CAST(s_suppkey AS STRING), 'in', 'ID' || CAST(s_suppkey AS STRING), 'SystemID' FROM {supplier}
UNION ALL SELECT 'OB' || CAST(c_custkey AS STRING), 'in', 'SC' || CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE CAST(FLOOR(c_custkey / 10) AS BIGINT) END AS STRING), 'Schema' FROM {customer}
UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN CAST(NULL AS STRING) ELSE 'TL0_' || r_name END, 'in', CAST(NULL AS STRING), 'Client' FROM {region}
UNION ALL SELECT CAST(NULL AS STRING), 'in', 'TL' || CAST(s_suppkey * 3 AS STRING), 'Tool' FROM {supplier} WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'ID0_' || r_name, 'in', CASE WHEN r_regionkey < 2 THEN CAST(NULL AS STRING) ELSE 'SY2' END, 'System' FROM {region}
UNION ALL SELECT 'OB' || CAST(o_custkey AS STRING), 'Loaded From', 'OB' || CAST(o_orderkey AS STRING),
 CASE WHEN o_custkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE 'Table' END FROM {orders}
UNION ALL SELECT 'OB' || CAST(r_regionkey AS STRING), 'Loaded From', CAST(NULL AS STRING), 'Table' FROM {region}
""",
}


def tables_of(sql: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(sql) if field})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the long ones are shared out if they come as few splits, those that become statements always."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in STATEMENT_TABLES:
        return spread_evenly(df)
    return spread(df) if name in LONG_TABLES else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables_of(sql)})


def fixture_cte(*names: str) -> str:
    """``WITH`` entries for DuckDB, over the views the driver registers."""
    return ",\n".join(
        f"{name} AS ({FIXTURES[name].format(**{t: t for t in tables_of(FIXTURES[name])})})" for name in names
    )
