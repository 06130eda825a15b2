"""Kinds, targets, sources and edges of single statements."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from tablewake.functions.text import clean_statement
from tablewake.operators.extract import extract_edges, parse_statements, statement_errors
from tablewake.operators.reports import error_histogram, run_statistics

from .conftest import rows

CASES = [
    ("INSERT INTO a.b SELECT * FROM c.d JOIN e ON 1=1", "Insert", ["a.b"], ["c.d", "e"]),
    ("ins t (x) sel x from u, v w, z.q as k where 1=1", "Insert", ["t"], ["u", "v", "z.q"]),
    ("SEL * FROM a x, b.c y", "Select", [], ["a", "b.c"]),
    ("( select 1 from a ) union (select 2 from b)", "Select", [], ["a", "b"]),
    ("with q (c) as (select c from t), r as (select * from Q) select * from r join R2 on 1=1", "Select", [], ["t", "R2"]),
    ("create multiset volatile table vt as (select extract(year from dt) y from p.q) with data", "Create", ["vt"], ["p.q"]),
    ('REPLACE VIEW sem . "My V" AS SELECT \'x from y\' c FROM b . c', "Create", ["sem.My V"], ["b.c"]),
    ("CREATE TABLE IF NOT EXISTS t (a INT)", "Create", ["t"], []),
    ("DELETE FROM db.t WHERE k IN (SELECT k FROM db.u)", "Delete", ["db.t"], ["db.u"]),
    ("del db.t where k in (select k from db.t)", "Delete", ["db.t"], ["db.t"]),
    ("DEL db.t ALL", "Delete", ["db.t"], []),
    ("MERGE INTO m.t USING m.s ON 1=1 WHEN MATCHED THEN UPDATE SET a=1", "Merge", ["m.t"], ["m.s"]),
    ("UPDATE t FROM a.b x SET c=1", "Update", ["t"], ["a.b"]),
    ("insert into t select * from t", "Insert", ["t"], ["t"]),
    ("select a -- from no\n from yes /* join no */", "Select", [], ["yes"]),
    ("select * from table (f(x)) as t, u", "Select", [], ["u"]),
    ("UPDATE tgt FROM db.real tgt, db.src s SET a = s.a, b = 2", "Update", ["db.real"], ["db.src"]),
    ("upd t from db.a AS x, t2 set c=1 where x.k in (sel k from db.b)", "Update", ["t"], ["db.a", "t2", "db.b"]),
    ("DELETE a FROM db.t1 a, db.t2 b WHERE a.k=b.k", "Delete", ["db.t1"], ["db.t2"]),
    ("insert into a select * from b a", "Insert", ["a"], ["b"]),
    ("SELECT * FROM (SEL x FROM a.b) q, d.e f, g", "Select", [], ["a.b", "d.e", "g"]),
    ("SELECT 1 FROM b.c q LEFT JOIN d.e f ON q.x = f(q.y, 1), g.h i WHERE 1 IN (2, 3) GROUP BY u, v", "Select", [], ["b.c", "d.e", "g.h"]),
    ("sel 1 from a where c IS NOT DISTINCT FROM d and e is distinct from f", "Select", [], ["a"]),
    ("SELECT \"it's\" FROM a.b WHERE c='x' and d = 'y from z'", "Select", [], ["a.b"]),
    ("select 1 from Été.t, Straße.x y, db.tëst as z", "Select", [], ["Été.t", "Straße.x", "db.tëst"]),
    ("insert into s.a.b.c select * from w.x.y.z", "Insert", ["s.a.b.c"], ["w.x.y.z"]),
    ('sel * from db."T.v" t join "a"."b" on 1=1', "Select", [], ['db."T.v"', "a.b"]),
    ("USING (k INT, d DECIMAL(10,2)) INSERT INTO a.b SELECT :k FROM c", "Insert", ["a.b"], ["c"]),
    ("LOCKING TABLE b.c FOR WRITE INSERT INTO b.c SELECT * FROM d", "Insert", ["b.c"], ["d"]),
    ("lock row for read lock table x in share mode sel 1 from x", "Select", [], ["x"]),
    ("SEL EXTRACT(YEAR FROM CAST(COALESCE(NULLIF(TRIM(SUBSTR(x,(1+1),3)),''),(sel max(y) from m.n)) AS DATE)) FROM t", "Select", [], ["m.n", "t"]),
    ("select * from ((((a)))) , (b join (c cross join d) on (1=1)), strtok(e) f, g", "Select", [], ["a", "b", "c", "d", "g"]),
    ("create view v as with q as (sel 1 from a), r as (sel 2 from q) sel * from r, b union all sel 3 from c", "Create", ["v"], ["a", "b", "c"]),
    ("select d.x from lateral (select 1 from inner1) d", "Select", [], ["inner1"]),
    ("select extract(year from cast(trim(both from x) as date)) from t", "Select", [], ["t"]),
    ("sel * from ((a.b x join c on 1=1) left join (sel 1 from d) e on 1=1) join f using (id)", "Select", [], ["a.b", "c", "d", "f"]),
    ("create table a.b as c.d with no data", "Create", ["a.b"], ["c.d"]),
    ("create volatile table b, no log as c with data on commit preserve rows", "Create", ["b"], ["c"]),
    ("merge into t using (select a from u) s on 1=1", "Merge", ["t"], ["u"]),
    ("DROP TABLE a.b", "Drop", [], []),
    ("COLLECT STATISTICS ON t", "Command", [], []),
    ("CALL p(1)", "Command", [], []),
    ("hello world", None, [], []),
    ("  _x000d_ ", None, [], []),
    ("USING (k INT, d DECIMAL(10,2), e PERIOD(TIMESTAMP(6))) INSERT INTO a.b SELECT * FROM c.d", "Insert", ['a.b'], ['c.d']),
    ("USING (k INT, f(g(h(1)))) LOCKING TABLE q FOR READ INSERT INTO a.b SELECT * FROM c.d", "Insert", ['a.b'], ['c.d']),
    ("CREATE JOIN INDEX a.j AS SELECT * FROM c.d", "Create", ['a.j'], ['c.d']),
    ("CREATE GLOBAL TEMPORARY TRACE TABLE a.tr (x INT)", "Create", ['a.tr'], []),
    ("create table a.b, fallback, checksum = default, with journal table = j.k, map (m(1)) as c.d with no data", "Create", ['a.b'], ['c.d']),
    ("create table a.b, fallback as c.d with data", "Create", ['a.b'], ['c.d']),
    ('WITH q (a DECIMAL(10,2), "c(") AS (SELECT * FROM t), r (d) AS (SEL * FROM q) SELECT * FROM r, z', "Select", [], ['t', 'z']),
    ("with recursive q (a) as (select a from t1 union all select a from q join t2 on 1=1) select * from q", "Select", [], ['t1', 't2']),
    ("select del, ins from t", "Select", [], ['t']),
    ("select del from t", "Select", [], ['t']),
    ("select a, x is not distinct from b from t", "Select", [], ['t']),
    ("LOCKING a.b FOR READ", "Command", [], []),
    ("hello insert into x select * from y", None, [], ['y']),
    ("DELETE FROM a.b", "Delete", ['a.b'], []),
    ("DELETE a.b FROM c.d x, e WHERE 1=1", "Delete", ['a.b'], ['c.d', 'e']),
    ("select top 5 with ties a from t", "Select", [], ['t']),
    ("select x.from_dt, t.sample, replace(a,'b','c') from f join g on g.sample = 1, h", "Select", [], ['f', 'g', 'h']),
    ("insert into a.b (c, d) select c, d from e.f", "Insert", ['a.b'], ['e.f']),
    ("insert a.b (1, 2)", "Insert", ['a.b'], []),
    ("insert into a.b values ((1),(select max(x) from q))", "Insert", ['a.b'], ['q']),
    ("MERGE INTO t USING s ON (t.a=s.a) WHEN MATCHED THEN UPDATE SET a=1 WHEN NOT MATCHED THEN INSERT (a,b) VALUES (1,2)", "Merge", ['t'], ['s']),
]


def statements(spark, sqls):
    return spark.createDataFrame([("scr", i, s) for i, s in enumerate(sqls)], "script_file string, pos long, sql_text string")


def test_references(spark):
    parsed = parse_statements(statements(spark, [c[0] for c in CASES])).orderBy("pos").collect()
    for (sql, kind, targets, sources), row in zip(CASES, parsed):
        assert (row.kind, row.targets, row.sources) == (kind, targets, sources), sql


def edges(spark, sqls, **options):
    return extract_edges(parse_statements(statements(spark, sqls)), "run", **options)


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("insert into a.b select * from c", [("a.b", "Insert", "scr.c", False)]),
        ("insert into b values (1)", [("scr.b", "Insert", None, False)]),
        ("select 1 from c.d", [("run-scr", "Select", "c.d", True)]),
        ("select 1", []),
        ("delete from a.b", []),
        ("del b where x in (select x from b)", [("scr.b", "Delete", "scr.b", False)]),
        ("collect statistics on t", []),
        ("drop table t", []),
        ("nonsense from t", []),
    ],
)
def test_edges(spark, sql, expected):
    got = edges(spark, [sql]).drop("script_file")
    assert rows(got) == expected


def test_query_edges(spark):
    got = edges(spark, ["insert into a.b select * from c.d", "select 1 from c.d", "delete from a.b where 1 in (sel 1 from e.f)"], include_query_edges=True)
    assert rows(got.drop("script_file")) == [
        ("a.b", "Delete", "e.f", False),
        ("a.b", "Insert", "c.d", False),
        ("run", "Insert", "a.b", True),
        ("run-scr", "Select", "c.d", True),
    ]


def test_one_query_name_for_all_scripts(spark):
    got = edges(spark, ["select 1 from c.d", "insert into a select * from b"], per_script=False)
    assert rows(got, "child_table_name", "is_query") == [("run", True), ("scr.a", False)]


def test_errors_and_counts(spark):
    parsed = parse_statements(statements(spark, ["sel 1", "what", " _x000D_", "oops", "drop table t"]))
    assert rows(statement_errors(parsed), "pos", "sql_query", "error_type") == [
        (1, "what", "UnrecognizedStatement"), (2, "  ", "EmptyQuery"), (3, "oops", "UnrecognizedStatement"),
    ]
    assert rows(run_statistics(parsed)) == [(5, 2, 3, 40.0, 60.0, 0)]
    assert [tuple(r) for r in error_histogram(parsed).collect()] == [("UnrecognizedStatement", 2, 66.7), ("EmptyQuery", 1, 33.3)]


def test_no_statements(spark):
    parsed = parse_statements(statements(spark, ["x"]).where(F.lit(False)))
    assert extract_edges(parsed, "run").columns == ["script_file", "child_table_name", "relationship", "parent_table_name", "is_query"]
    assert rows(run_statistics(parsed)) == [(0, 0, 0, None, None, 0)]


def test_parsing_is_not_repeated(spark):
    """The plan holds each pattern of the parser a fixed number of times, whatever is read from it."""
    plan = edges(spark, ["sel 1"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("locking.*?access") == 1
    assert plan.count("multiset") == 1
    assert plan.count("aggregate(") == 1


def test_statements_of_one_row_group_are_dealt_out(spark, tmp_path):
    """Splits of a file without a row group of their own are empty, so their number does not share out the rows."""
    orders = spark.range(40_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "4096")
    try:
        stated = fixture(spark, str(tmp_path), "fx_hard_statements")
        sizes = [r[0] for r in stated.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*")).select("count(1)").collect()]
    finally:
        spark.conf.unset(key)
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / spark.sparkContext.defaultParallelism


def test_clauses_go_only_where_they_stand(spark):
    texts = ["a_x000D_b", "Locking t for Access sel 1", "NONSEQUENCED x TransactionTime sel 1", "sequenced y transactiontime s", "locking sequenced", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(clean_statement(F.col("t"))).collect()]
    assert got == ["a b", "  sel 1", "  sel 1", "  s", "locking sequenced", "", None]
