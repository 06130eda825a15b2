"""Scans, sinks and whole jobs over temporary folders."""

from pathlib import Path

import pytest

from pyspark.sql import functions as F

from tablewake import session
from tablewake.operators.catalog import catalog_lookup
from tablewake.operators import statements
from tablewake.operators.lines import log_statements
from tablewake.operators.scans import scan_before
from tablewake.plans import jobs
from tablewake.sources import files, sinks, tables

from .conftest import rows

LOG = """BTEQ 16.20
+---------+
/* a
 comment; */ SELECT a
-- gone
  FROM db.src;
 3 rows found
.QUIT
INSERT INTO db.t /* x */
SELECT * FROM vt; SEL 1 FROM db.y;
*** done
update db.t set a = 1;
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.sql").write_text("insert into a.b select * from c;\r\nsel 1 from d.e;;\n")
    (tmp_path / "in" / "deep" / "two.TXT").write_text("create volatile table c as (sel * from f.g) with data;\rbad one")
    (tmp_path / "in" / "deep" / "one.Sql").write_text("delete from a.b where x in (sel y from h.i)")
    (tmp_path / "in" / "notes.md").write_text("select * from no;")
    (tmp_path / "in" / "deep" / "l1.LOG").write_text(LOG)
    (tmp_path / "in" / "l2.msg").write_text("noise\nsel x from q.r\n")
    return tmp_path


def test_script_scan(spark, folder):
    path = str(folder / "in")
    assert rows(files.read_scripts(spark, path), "script_file", "text") == [
        ("one", "delete from a.b where x in (sel y from h.i)"),
        ("one", "insert into a.b select * from c;\nsel 1 from d.e;;\n"),
        ("two", "create volatile table c as (sel * from f.g) with data;\nbad one"),
    ]
    assert files.read_scripts(spark, f"{path}/one.sql").count() == 1
    assert files.read_script_lines(spark, f"{path}/notes.md").count() == 0
    assert rows(jobs.script_statements(spark, path), "script_file", "pos", "sql_text") == [
        ("one", 0, "delete from a.b where x in (sel y from h.i)"),
        ("one", 0, "insert into a.b select * from c"),
        ("one", 1, "sel 1 from d.e"),
        ("two", 0, "create volatile table c as (sel * from f.g) with data"),
        ("two", 1, "bad one"),
    ]


def test_hidden_files_are_refused_by_name(spark, tmp_path):
    (tmp_path / "_archive").mkdir()
    for name in ("a.sql", "_b.sql", "_archive/c.sql", ".d.log", "_e.md"):
        (tmp_path / name).write_text("sel 1")
    with pytest.raises(ValueError, match=r"2 files .*/_archive/c.sql, .*/_b.sql"):
        files.read_script_lines(spark, str(tmp_path))
    with pytest.raises(ValueError, match=r"1 files .*/\.d\.log"):
        files.read_logs(spark, str(tmp_path))
    assert files.read_scripts(spark, str(tmp_path / "a.sql")).count() == 1


def test_names_are_those_of_the_files(spark, tmp_path):
    names = ("my file", "a+b", "50%20", "é", "x.y")
    for name in names:
        (tmp_path / f"{name}.sql").write_text("sel 1")
    assert sorted(r.script_file for r in files.read_scripts(spark, str(tmp_path)).collect()) == sorted(names)
    assert sorted(r.script_file for r in files.read_script_lines(spark, str(tmp_path)).collect()) == sorted(names)


def test_log_scan(spark, folder):
    path = str(folder / "in")
    assert files.read_logs(spark, path).count() == 2
    found = log_statements(files.read_log_lines(spark, path), files.FILE_KEYS)
    assert rows(found, "script_file", "sql_text") == [
        ("l1", " SELECT a\n  FROM db.src;"),
        ("l1", "INSERT INTO db.t \nSELECT * FROM vt; SEL 1 FROM db.y;"),
        ("l1", "update db.t set a = 1;"),
        ("l2", "sel x from q.r"),
    ]


def test_a_large_file_is_read_as_many_splits(spark, tmp_path):
    lines = [f"insert into t{i}\n select * from s{i}; sel {i}" for i in range(4000)]
    (tmp_path / "big.sql").write_text(";\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = files.read_script_lines(spark, str(tmp_path))
        assert numbered.select("block").distinct().count() > 5
        found = jobs.script_statements(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.sql_text for r in found] == [s.strip() for s in ";\n".join(lines).split(";")]


def test_a_large_log_is_read_as_many_splits(spark, tmp_path):
    text = "".join(f"noise\n/* open {i}\n still */ insert into t{i}\n-- c\n select {i};\n" for i in range(3000))
    (tmp_path / "big.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = log_statements(files.read_log_lines(spark, str(tmp_path)), files.FILE_KEYS)
        got = {r.sql_text for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f" insert into t{i}\n select {i};" for i in range(3000)}


@pytest.mark.parametrize(
    "columns, expected",
    [
        (["id", "LineNumber", "ViewName", "SQL", "query"], ("query", "LineNumber", "ViewName")),
        (["a", "b", "c"], ("c", "b", "a")),
        (["view_sql", "Query"], ("Query", "view_sql", "view_sql")),
        (["line_number"], ("line_number", "line_number", "line_number")),
    ],
)
def test_header_discovery(columns, expected):
    assert tuple(tables.discover_columns(columns)) == expected


def test_header_discovery_fails_on_one_unknown_column():
    with pytest.raises(ValueError):
        tables.discover_columns(["sql"])


def test_line_table(spark, tmp_path):
    (tmp_path / "views.csv").write_text('view_name,LineNumber,view_sql\nv1,10,from x.y\nv1,9,"select ""a"""\nv2,1,sel 1\n,1,lost\n')
    df = tables.read_script_table(spark, str(tmp_path / "views.csv"))
    assert rows(df.drop("row_number")) == [
        ("views", "v1", 10, "from x.y"), ("views", "v1", 9, 'select "a"'), ("views", "v2", 1, "sel 1"), ("views", None, 1, "lost"),
    ]
    out = str(tmp_path / "out")
    views = tables.view_names(spark.read.csv(str(tmp_path / "views.csv"), header=True))
    jobs.table_lineage_job(df, out, "r", views=views, types=spark.createDataFrame([("x.y", "T", 1)], "obj_name string, table_kind string, ord long"))
    got = rows(spark.read.parquet(f"{out}/r-relations"), "child_table_name", "parent_table_name", "child_table_type", "parent_table_type")
    assert got == [("R-VIEWS", "X.Y", "UNKNOWN", "TABLE")]


@pytest.mark.parametrize(
    "lines, text",
    [
        ([("1", "select b"), ("1", "from a.t"), ("1", "where 1=1")], "select b\nfrom a.t\nwhere 1=1"),
        ([("1.5", "b"), ("1", "a"), ("10", "d"), ("2", "c")], "a\nb\nc\nd"),
        ([("p02", "b"), ("p01", "a"), ("p02", "a2"), ("p10", "c")], "a\nb\na2\nc"),
    ],
)
def test_line_order(spark, lines, text):
    df = spark.createDataFrame([("q", n, line) for n, line in lines], "SQLName string, LineNumber string, sql string").coalesce(1)
    found = tables.read_script_table(spark, df)
    assert [r.query_text for r in statements.assemble_queries(found).collect()] == [text]
    assert [r.sql_text for r in statements.table_statements(found, rows=2).collect()] == [text]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_relations_come_back_as_written(spark, tmp_path, fmt):
    schema = "script_file string, child_table_name string, relationship string, parent_table_name string, child_table_type string, parent_table_type string"
    df = spark.createDataFrame([("s", 'a "b", c', "INSERT", None, "VIEW", "007"), ("t", "x\\y", "DELETE", "q", None, "TABLE")], schema)
    sinks.write_relations(df, str(tmp_path / "run-relations"), fmt)
    back = tables.read_relations(spark, str(tmp_path / "run-relations"))
    assert back.columns == df.columns and rows(back) == rows(df)


def test_scan_keeps_rows_with_null_keys(spark):
    data = [(None, "a", 1), (None, "b", 2), (7, "c", 1), (None, None, 3)]
    df = spark.createDataFrame(data, "k int, line string, pos long").withColumn("block", F.lit(0))
    found = scan_before(df, ["k"], total={"n": F.lit(1).cast("long")})
    assert rows(found, "k", "pos", "n") == [(7, 1, 0), (None, 1, 0), (None, 2, 1), (None, 3, 2)]


def test_relations_in_all_spellings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SCRIPT_FILE,CHILDTABLENAME,RELATIONSHIP,PARENTTABLENAME,CHILDTABLETYPE,PARENTTABLETYPE\nS,NA,INSERT,,VIEW,007\n")
    (tmp_path / "b.csv").write_text("parentTypes,childTableName,script_file\nVIEW,null,x\n")
    assert rows(tables.read_relations(spark, str(tmp_path / "a.csv"))) == [("S", "NA", "INSERT", None, "VIEW", "007")]
    assert tables.read_relations(spark, str(tmp_path / "b.csv")).columns == ["parent_table_type", "child_table_name", "script_file"]


def test_object_types(spark, tmp_path):
    (tmp_path / "o.csv").write_text("obj_name,TableKind\nb,V\na,T\n")
    assert [r.obj_name for r in tables.read_object_types(spark, str(tmp_path / "o.csv")).orderBy("ord").collect()] == ["b", "a"]


def test_empty_results_leave_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "a string")
    assert sinks.write_relations(empty, str(tmp_path / "none")) == 0
    assert not (tmp_path / "none").exists()
    assert sinks.write_relations(spark.range(3), str(tmp_path / "some"), "csv") == 3
    assert sinks.sample(spark.range(30)).count() == 10


def test_script_job_end_to_end(spark, folder):
    out = str(folder / "out")
    types = spark.createDataFrame([("a.b", "T", 1), ("F.G", "T", 2), ("h.i", "V", 3), ("d.e", "T", 4)], "obj_name string, table_kind string, ord long")
    stats = jobs.script_lineage_job(spark, str(folder / "in"), out, "run", types=types, fmt="csv")
    assert rows(stats["statistics"]) == [(5, 4, 1, 80.0, 20.0, 4)]
    assert rows(stats["errors"]) == [("UnrecognizedStatement", 1, 100.0)]
    typed = tables.read_relations(spark, f"{out}/run-relations")
    assert rows(typed, "script_file", "child_table_name", "relationship", "parent_table_name", "child_table_type", "parent_table_type") == [
        ("ONE", "A.B", "DELETE", "H.I", "TABLE", "VIEW"),
        ("ONE", "A.B", "INSERT", "ONE.C", "TABLE", "VOLTABLE"),
        ("ONE", "RUN-ONE", "SELECT", "D.E", "UNKNOWN", "TABLE"),
        ("TWO", "TWO.C", "CREATE", "F.G", "VOLTABLE", "TABLE"),
    ]
    errors = spark.read.csv(f"{out}/run-error_details", header=True, multiLine=True, escape='"')
    assert rows(errors) == [("two", "4", "bad one", "UnrecognizedStatement", "The statement starts with no known verb")]
    jobs.resolve_job(typed, f"{out}/simplified")
    assert rows(spark.read.parquet(f"{out}/simplified"), "child_table_name", "relationship", "parent_table_name") == [
        ("A.B", "DELETE", "H.I"), ("RUN-ONE", "Loaded From", "D.E"),
    ]


def test_a_folder_of_scripts_and_line_tables(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.sql").write_text("insert into a.b select * from v1;\nsel 1 from d.v2")
    (tmp_path / "in" / "views.csv").write_text('view_name,LineNumber,view_sql\nd.v2,2,"from x.y\n join x.z on 1=1"\nd.v2,1,replace view d.v2 as sel *\n')
    spark.createDataFrame([("q", 1, "delete from a.b where 1 in (sel 1 from x.y);what")], "QueryNumber string, LineNumber int, sql string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    file.rename(tmp_path / "in" / "deep" / "tab.parquet")
    types = spark.createDataFrame([("x.y", "T", 1), ("a.b", "T", 2)], "obj_name string, table_kind string, ord long")
    stats = jobs.folder_lineage_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r", types=types)
    assert rows(stats["statistics"], "total_queries", "failed_queries") == [(5, 1)]
    got = spark.read.parquet(str(tmp_path / "out" / "r-relations"))
    assert rows(got.drop("relationship")) == [
        ("ONE", "A.B", "ONE.V1", "TABLE", "VOLTABLE"),
        ("ONE", "R-ONE", "D.V2", "UNKNOWN", "VIEW"),
        ("TAB", "A.B", "X.Y", "TABLE", "TABLE"),
        ("VIEWS", "D.V2", "X.Y", "VIEW", "TABLE"),
        ("VIEWS", "D.V2", "X.Z", "VIEW", "VOLTABLE"),
    ]
    jobs.folder_lineage_job(spark, str(tmp_path / "in" / "views.csv"), str(tmp_path / "one"), "r")
    assert spark.read.parquet(str(tmp_path / "one" / "r-relations")).count() == 2


def test_log_jobs(spark, folder):
    path, out = str(folder / "in"), str(folder / "clean")
    jobs.clean_logs_job(spark, path, out)
    texts = {p.parent.name: p.read_text() for p in (folder / "clean").rglob("part-*")}
    assert texts == {
        "script_file=l1": " SELECT a\n  FROM db.src;\n\n\nINSERT INTO db.t \nSELECT * FROM vt; SEL 1 FROM db.y;\n\n\nupdate db.t set a = 1;\n\n\n",
        "script_file=l2": "sel x from q.r\n",
    }
    jobs.log_lineage_job(spark, path, str(folder / "lineage"), "r")
    got = spark.read.parquet(str(folder / "lineage" / "r-relations"))
    assert rows(got, "child_table_name", "parent_table_name") == [
        ("DB.T", "L1.VT"), ("DB.T", None), ("R-L1", "DB.SRC"), ("R-L1", "DB.Y"), ("R-L2", "Q.R"),
    ]


def test_hierarchy_job(spark, tmp_path):
    data = [("app", "in", "sec", "Sector"), ("obj", "in", "sch", "Schema"), ("obj", "Loaded From", "obj", "Table")]
    df = spark.createDataFrame(data, "child_table_name string, relationship string, parent_table_name string, parent_table_type string")
    stats = jobs.hierarchy_job(df, str(tmp_path / "h"))
    assert rows(stats) == [("Relationship", 1), ("Schema", 1), ("Sector", 1)]
    flat = spark.read.csv(str(tmp_path / "h" / "final_output"), header=True)
    assert (len(flat.columns), rows(flat, "ParentSchema", "ParentObjectName", "ChildSector")) == (19, [("sch", "obj", None)])
    assert spark.read.csv(str(tmp_path / "h" / "hierarchy_table"), header=True).count() == 2
    assert spark.read.csv(str(tmp_path / "h" / "relationship_table"), header=True).count() == 1


def test_empty_input(spark, tmp_path):
    """No statements, no edges, no levels: empty results with their columns."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.sql").write_text("  ;\n")
    out = str(tmp_path / "out")
    stats = jobs.script_lineage_job(spark, str(tmp_path / "in"), out, "run")
    assert rows(stats["statistics"]) == [(0, 0, 0, None, None, 0)] and stats["errors"].count() == 0
    assert not list((tmp_path / "out").glob("run-*"))
    none = spark.createDataFrame([], "script_file string, child_table_name string, relationship string, parent_table_name string, child_table_type string, parent_table_type string")
    assert rows(jobs.resolve_job(none, f"{out}/simplified"), "n")[0] == (0,)
    jobs.hierarchy_job(none, f"{out}/hierarchy")
    assert not list((tmp_path / "out").rglob("*.parquet")) and not list((tmp_path / "out").rglob("*.csv"))


def test_jobs_leave_no_intermediate_tables(spark, folder):
    def saved():
        return {p for p in Path(session.save_folder(spark)).rglob("*") if p.is_dir()}

    before = saved()
    out = str(folder / "out")
    jobs.script_lineage_job(spark, str(folder / "in"), out, "run")
    jobs.clean_logs_job(spark, str(folder / "in"), f"{out}/clean")
    jobs.resolve_job(spark.read.parquet(f"{out}/run-relations"), f"{out}/simplified")
    with pytest.raises(Exception):
        jobs.script_lineage_job(spark, str(folder / "in"), out, "run")
    assert saved() - before == set()


def test_a_failed_job_publishes_nothing(spark, folder, monkeypatch):
    out = folder / "out"

    def fails(*args, **options):
        raise RuntimeError("no room")

    monkeypatch.setattr(jobs, "write_errors", fails)
    with pytest.raises(RuntimeError, match="no room"):
        jobs.script_lineage_job(spark, str(folder / "in"), str(out), "run")
    assert not out.exists()
    levels = spark.createDataFrame([("app", "in", "sec", "Sector")], "child_table_name string, relationship string, parent_table_name string, parent_table_type string")
    real, calls = sinks.write_relations, []
    monkeypatch.setattr(sinks, "write_relations", lambda *a, **o: calls.append(a) or (fails() if len(calls) == 3 else real(*a, **o)))
    with pytest.raises(RuntimeError, match="no room"):
        jobs.hierarchy_job(levels, str(folder / "h"))
    assert len(calls) == 3 and not (folder / "h").exists()


def test_published_together_with_a_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    with sinks.staged(spark, out) as stage:
        for name in ("a", "b"):
            sinks.write_relations(spark.range(2), f"{stage}/{name}")
        assert not list((tmp_path / "out").glob("[!_]*"))
    (manifest,) = (tmp_path / "out").glob("_published-*")
    assert manifest.read_text() == "a\nb\n" and spark.read.parquet(f"{out}/a").count() == 2
    with pytest.raises(FileExistsError, match="out/b"):
        with sinks.staged(spark, out) as stage:
            for name in ("b", "c"):
                sinks.write_relations(spark.range(2), f"{stage}/{name}")
    assert not (tmp_path / "out" / "c").exists() and not list((tmp_path / "out").glob("_staged-*"))


def test_rows_of_several_files_come_in_order_of_name(spark, tmp_path):
    """A long file is read before a short one, yet its rows come after."""
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.csv").write_text("obj_name,TableKind\nx,V\ny,V\n")
    (tmp_path / "o" / "b.csv").write_text("obj_name,TableKind\nx,T\n" + "".join(f"z{i},T\n" for i in range(500)))
    types = tables.read_object_types(spark, str(tmp_path / "o"))
    assert [r.obj_name for r in types.orderBy("ord").limit(4).collect()] == ["x", "y", "x", "z0"]
    assert {r.key: r.table_kind for r in catalog_lookup(types).where("key IN ('X', 'Y')").collect()} == {"X": "T", "Y": "V"}
    lines = "".join(f"q,1,l{i}\n" for i in range(300))
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.csv").write_text("QueryNumber,LineNumber,sql\nq,1,first\n")
    (tmp_path / "q" / "b.csv").write_text("QueryNumber,LineNumber,sql\n" + lines)
    table = tables.read_script_table(spark, str(tmp_path / "q"), "s")
    assert [r.query_text for r in statements.assemble_queries(table).collect()] == ["\n".join(["first", *(f"l{i}" for i in range(300))])]


def test_errors_of_unnamed_and_equal_places(spark, tmp_path):
    bad = spark.createDataFrame([("s", 1, "what"), ("s", 1, "how"), (None, 2, "why"), ("s", 3, "sel 1")], "script_file string, pos long, sql_text string")
    jobs.lineage_job(bad, str(tmp_path), "r")
    errors = spark.read.csv(str(tmp_path / "r-error_details"), header=True)
    assert sorted(r.sql_query for r in errors.collect()) == ["how", "what", "why"]


def test_save_points_can_be_cleared(spark):
    file = session.save_point(spark.range(2)).inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert Path(file).exists()
    session.clear_save_points(spark)
    assert not Path(file).exists()


def test_intermediate_tables_go_to_the_shared_folder(spark):
    saved = session.save_point(spark.range(2))
    assert saved.count() == 2
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named is None or named.split(":")[-1] in saved.inputFiles()[0]
