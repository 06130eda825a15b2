"""Lines, comments, sessions and statements against plain restatements."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from checks.registry import QUERIES, _files
from tablewake.functions import text as T
from tablewake.operators import lines as L
from tablewake.operators import statements as S
from tablewake.operators.scans import scan_before, scan_two_states, text_digest
from tablewake.session import save_point

from .conftest import rows


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "script_file long, text string")


def numbered(spark, values, block=3):
    return L.split_lines(texts(spark, values), rows=block)


def test_scan_before_crosses_blocks(spark):
    data = [("a", i // 4, i, i if i % 5 == 0 else None) for i in range(23)] + [("b", 0, 0, 7)]
    df = spark.createDataFrame(data, "k string, block long, pos long, v long")
    got = scan_before(df, ["k"], last={"seen": F.col("v")}, total={"n": F.lit(1)})
    expected = []
    for k, _, pos, _ in data:
        earlier = [d for d in data if d[0] == k and d[2] < pos]
        seen = [d[3] for d in earlier if d[3] is not None]
        expected.append((k, pos, seen[-1] if seen else None, len(earlier)))
    assert rows(got, "k", "pos", "seen", "n") == sorted(expected, key=lambda r: (r[0], str(r[1])))


def test_comment_lines_equal_whole_text(spark):
    rng = random.Random(5)
    pieces = ["/*", "*/", "/*/", "*/*", "/**/", "a", " ", "\n", "\n", "x;", "--"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    kept = L.strip_comment_lines(numbered(spark, values))
    got = {}
    for script, block, pos, line in kept.collect():
        got.setdefault(script, []).append((block, pos, line))
    for script, value in enumerate(values):
        joined = "\n".join(line for _, _, line in sorted(got.get(script, [])))
        assert joined == re.sub(r"/\*.*?\*/", "", value, flags=re.S), value


def test_comment_scan_writes_once_and_shuffles_lines_once(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save_point(df)

    monkeypatch.setattr(L, "save_point", seen)
    assert L.strip_comment_lines(numbered(spark, ["a /* b\nc\nd */ e", "/*"])).count() == 2
    # The lines, by file and block, are read by the summary and the join; the summaries go by file and back by block.
    assert len(plans) == 1 and plans[0].count("Exchange") <= 4


def test_two_states_over_blocks(spark):
    rng = random.Random(11)
    data = [(k, i // 4, i, rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3) for k in (None, "a", "b") for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(data, "k string, block long, pos long, a0 boolean, a1 boolean, o boolean")
    got = scan_two_states(df, ["k"], (F.col("a0"), F.col("a1")), F.col("o")).collect()
    found = {(r.k or None, r.pos): (r.state, r.head and tuple(r.head), r.unclosed and tuple(r.unclosed)) for r in got}
    for k in (None, "a", "b"):
        state, head, entered, want = 0, None, None, {}
        for _, block, pos, a0, a1, o in sorted(d for d in data if d[0] == k):
            head = (block, pos) if state == 0 else head
            want[k, pos] = (state, head)
            after = a1 if state else a0
            if after and (state == 0 or o):
                entered = (block, pos)
            state = int(after)
        assert {key: v[:2] for key, v in found.items() if key[0] == k} == want
        assert {v[2] for key, v in found.items() if key[0] == k} == {entered if state else None}


def statements_of(log):
    """One pass over the lines: what a statement is."""
    out, current = [], None
    for line in log.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith(("--", "***", ".")):
            continue
        if current is None and bare.upper().startswith(T.STATEMENT_STARTS):
            current = []
        if current is not None:
            current.append(line)
            if bare.endswith(";"):
                out.append("\n".join(current))
                current = None
    return out + (["\n".join(current)] if current else [])


def found(spark, logs):
    return L.assemble_statements(L.sessionise(numbered(spark, logs)))


def test_sessions_equal_state_machine(spark):
    rng = random.Random(6)
    pieces = ["SELECT a", "  from b;", "noise", "-- c", "*** ok", ".QUIT", "", "sel 1;", "WITH DATA;", "12 rows", "del x"]
    logs = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    got = {}
    for script, block, pos, sql in found(spark, logs).collect():
        got.setdefault(script, []).append((block, pos, sql))
    for script, log in enumerate(logs):
        assert [s for _, _, s in sorted(got.get(script, []))] == statements_of(log), log


def test_log_cases(spark):
    logs = [
        "INSERT INTO t\nSELECT a FROM b;",  # the last line starts like a statement: still one
        "SELECT 1; -- x\nselect 2",  # never closes
        "update t\n\n-- c\n  set a=1;\t\ndone",
        "selfish\nSEL \nSEL 1;",  # SEL needs its blank
    ]
    got = {script: sql for script, _, _, sql in found(spark, logs).collect()}
    assert got == {
        0: "INSERT INTO t\nSELECT a FROM b;",
        1: "SELECT 1; -- x\nselect 2",
        2: "update t\n  set a=1;\t",
        3: "SEL 1;",
    }


def test_statement_lines_equal_whole_text(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice(["a", ";", " ", "\n", "b c", ";;"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    whole = S.split_statements(texts(spark, values)).select("script_file", "pos", "sql_text")
    by_line = S.split_statement_lines(numbered(spark, values)).select("script_file", "pos", "sql_text")
    expected = [
        (script, pos, piece.strip())
        for script, value in enumerate(values)
        for pos, piece in enumerate(value.split(";"))
        if piece.strip()
    ]
    assert rows(by_line) == rows(whole)
    assert sorted(rows(by_line)) == sorted(expected)


def test_queries_of_a_line_table(spark):
    data = [
        ("s", "b", 2, "from t"), ("s", "b", 1, "select 1"), ("s", "a", 10, "x;y"), ("s", "a", 9, None),
        ("s", None, 1, "lost"), ("r", "a", 1, "z"), ("s", "b", 1_000_000, ";tail"),
    ]
    lines = spark.createDataFrame(data, "script_file string, query_name string, line_number long, line string")
    queries = S.assemble_queries(lines, rows=5)
    assert rows(queries) == [
        ("r", "a", "z"), ("s", "a", "\nx;y"), ("s", "b", "select 1\nfrom t\n;tail"),
    ]
    assert rows(S.table_statements(lines, rows=5), "script_file", "query_name", "sql_text") == [
        ("r", "a", "z"), ("s", "a", "x"), ("s", "a", "y"), ("s", "b", "select 1\nfrom t"), ("s", "b", "tail"),
    ]


def test_equal_lines_keep_their_own_statements(spark):
    lines = spark.createDataFrame([("s", 0, 1, "x;y")] * 3, "script_file string, block long, pos long, line string")
    got = S.split_statement_lines(lines, order=("pos", "line"))
    assert rows(got, "pos", "sql_text") == [(0, "x"), (1, "y\nx"), (2, "y\nx"), (3, "y")]


def test_query_index_counts_all(spark):
    data = [(f"s{i % 7}", i, "x") for i in range(500)]
    df = spark.createDataFrame(data, "script_file string, pos long, sql_text string").repartition(5)
    got = {(s, p): i for s, p, _, i in S.with_query_index(df).collect()}
    assert got == {(s, p): i for i, (s, p, _) in enumerate(sorted(data))}


def cut(text, word, end):
    low = text.lower()
    start = low.find(word)
    stop = low.find(end, start) if start >= 0 else -1
    return text if stop < 0 else text[:start] + " " + text[stop + len(end):]


def test_clauses_removed_once(spark):
    rng = random.Random(8)
    words = ["LOCKING", "Access", "nonsequenced", "SEQUENCED", "TransactionTime", " ", "x", "_x000d_", "_x000D_", "_X000d_", "\n"]
    values = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    got = texts(spark, values).select("script_file", T.clean_statement(F.col("text"))).collect()
    for script, cleaned in got:
        expected = values[script].replace("_x000d_", " ").replace("_x000D_", " ")
        for word, end in (("locking", "access"), ("nonsequenced", "transactiontime"), ("sequenced", "transactiontime")):
            expected = cut(expected, word, end)
        assert cleaned == expected, values[script]


def test_whole_scripts_are_digested_piece_by_piece(spark):
    """Equals the digest of the text in one row; pieces of any length, empty and null ones, and groups without a name."""
    rng = random.Random(5)
    texts = [(rng.choice(["a", "b", None]), i, rng.choice(["", None, "x", "é\n\U0001f600", "line " * 50])) for i in range(700)]
    df = spark.createDataFrame(texts, "k string, pos long, line string").repartition(7)
    got = {r["k"]: (r["n_chars"], r["sha"]) for r in text_digest(df, ["k"], "line", ["pos"]).collect()}
    want = {}
    for k in ("a", "b", None):
        whole = "\n".join(t or "" for name, _, t in texts if name == k)
        want[k] = (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    assert got == want


def test_script_files_are_written_from_stretches(spark, tmp_path):
    """The file of a script has its lines by number and text; no task sorts them line by line."""
    rng = random.Random(6)
    placed = [(f"s{rng.randrange(3)}", rng.choice([None, rng.randrange(-9000, 30_000)]), rng.choice([None, "", "a", "b;"])) for _ in range(3_000)]
    df = spark.createDataFrame(placed, "script_file string, pos long, line string").repartition(5)
    folder = _files(df, str(tmp_path), ".sql")
    first = lambda v: (v is not None, v or 0)
    for name in ("s0", "s1", "s2"):
        lines = sorted((first(p), t is not None, t or "") for s, p, t in placed if s == name)
        with open(f"{folder}/{name}.sql") as file:
            assert file.read() == "".join(f"{t}\n" for _, _, t in lines)


def test_scan_of_scripts_builds_no_whole_script(spark, small):
    plan = QUERIES["scan_scripts"](spark, small)._jdf.queryExecution().toString()
    assert "sha2" not in plan
