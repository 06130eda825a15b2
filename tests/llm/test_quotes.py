import collections
import itertools
import random
import re

from tablewake.llm.queries import QUERIES
from tablewake.llm.quotes import ATTRIBUTION, quoted_lines, reply_order

SCHEMA = "conv_id long, turn long, role string, text string, level string, position string"
A, B, C = "I think the first plan\nis the best of all.", "No, take the second.", "Both are fine with me."
TALK = [
    (0, A),
    (1, "On Monday, Ann wrote:\n> I think  the FIRST plan\n> is the best of all.\n\n" + B),
    (2, "> > I think the first plan\n>> is the best of all.\n> No, take the second.\n" + C),
    (3, "> I think the first plan is the best of all.\nYes, go on."),
    (4, "And soon."),
    (5, "> No, take the second.\nWhy?"),
    (6, "> something that nobody said\nreally"),
    (7, None),
]


def found(spark, rows):
    return reply_order(spark.createDataFrame([(c, t, "user", x, "clash", "clash") for c, t, x in rows], SCHEMA)).collect()


def test_quotations_are_linked_and_left_out(spark):
    rows = {r.turn: r for r in found(spark, [(1, t, x) for t, x in TALK])}
    assert [rows[t].text for t in range(8)] == [A, B, C, "Yes, go on.", "And soon.", "Why?", "really", ""]
    assert [rows[t].parent_turn for t in range(8)] == [None, 0, 1, 0, 3, 1, 5, 6]
    assert [rows[t].quotes for t in range(8)] == [False, True, True, True, False, True, False, False]
    assert [rows[t].root_turn for t in range(8)] == [0, 0, 0, 3, 3, 5, 5, 5]
    assert [rows[t].n_quoted for t in range(8)] == [0, 2, 3, 1, 0, 1, 1, 0]
    # 0, its branch 3 4, then 1, its branch 5 6 7, then 2.
    assert [rows[t].position for t in range(8)] == [0, 3, 7, 1, 2, 4, 5, 6]


def plain_links(talk):
    """By definition, from the whole texts: quoted lines and runs of them against what each earlier message says itself."""
    def parts(text):
        lines, out = [], []
        raw = re.split("\r?\n", text or "")
        for i, line in enumerate(raw):
            marks = re.match(r"(?:\s*>)*", line).group()
            level = marks.count(">")
            named = not level and re.search(ATTRIBUTION, line) and i + 1 < len(raw) and re.match(r"\s*>", raw[i + 1])
            norm = " ".join(re.sub(r"^(?:\s*>)+ ?", "", line).lower().split())
            if norm and not named:
                lines.append((level, norm))
        for level, run in itertools.groupby(lines, lambda x: x[0]):
            run = [n for _, n in run]
            out += [(level, n) for n in run] + ([(level, " ".join(run))] if len(run) > 1 else [])
        return set(out)

    said = {t: parts(text) for t, text in talk}
    links = {}
    for t, _ in talk:
        sums = collections.Counter()
        for level, norm in said[t]:
            sources = [u for u in said if u < t and (0, norm) in said[u]]
            if level and sources:
                sums[level, max(sources)] += len(norm)
        if sums:
            links[t] = max(sums, key=lambda k: (-k[0], sums[k], k[1]))[1]
    return links


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(25):
        talk, vocabulary = [], [f"line {i} of {conv}" for i in range(8)]
        for t in range(12):
            lines = []
            for _ in range(rng.randrange(6)):
                lines.append(rng.choice(["", "", "> ", ">", "> > ", ">> "]) + rng.choice(vocabulary).replace(" ", rng.choice([" ", "  "])))
            if rng.random() < 0.3:
                lines.insert(0, "Bob wrote:")
            talk.append((t, rng.choice(["\n", "\r\n"]).join(lines)))
        rows += [(conv, t, x) for t, x in talk]
        want |= {(conv, t): p for t, p in plain_links(talk).items()}
    rows.append((99, 0, "> " * 3 + "deep\n" + "very long own line " * 40_000))
    got = {(r.conv_id, r.turn): r.parent_turn for r in found(spark, rows) if r.quotes}
    assert got == want and len(want) > 50


def walk(parents, turn):
    """Branches of a message before the message that follows it, by turn within each."""
    children = sorted(t for t, p in parents.items() if p == turn)
    follows = [t for t in children if t == turn + 1]
    out = [turn]
    for t in [t for t in children if t not in follows] + follows:
        out += walk(parents, t)
    return out


def test_deeply_nested_branches(spark):
    said = {t: f"words of message {t}" for t in range(24)}
    parents = {0: None} | {t: t - 1 if t % 2 else max(0, t - 3) for t in range(1, 24)}
    rows = [(5, t, (f"> {said[p]}\n" if p is not None else "") + said[t]) for t, p in parents.items()]
    got = found(spark, rows + [(6, 3, "alone"), (6, 3, "also"), (None, 1, "x"), (7, None, "y")])
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 5), key=lambda r: r.position)]
    assert order == walk(parents, 0)
    assert [(r.turn, r.text, r.position) for r in got if r.conv_id != 5] == [(3, "alone", 0)]


def test_same_line_in_all_messages_makes_no_pairs(spark):
    rows = {r.turn: r.parent_turn for r in found(spark, [(1, t, "> me too\nme too") for t in range(50)])}
    assert rows == {0: None} | {t: t - 1 for t in range(1, 50)}


def test_levels(spark):
    df = spark.createDataFrame([(1, 1, "u", "> > a\n>b\n > >> c\nd > e\r\n", "", "")], SCHEMA)
    assert [(r.level, r.line) for r in quoted_lines(df).orderBy("no").collect()] == [(2, "a"), (1, "b"), (3, "c"), (0, "d > e"), (0, "")]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_the_query_keeps_every_message(spark, tmp_path):
    rows = [(1, t, "user", x) for t, x in TALK]
    # A question and its answer numbered alike, one of them quoted later; a row given twice; rows without a key.
    rows += [(2, 0, "user", "What is it?"), (2, 0, "assistant", "It is this."), (2, 0, "user", "What is it?"), (2, 1, "user", "> It is this.\nWhy?")]
    rows += [(2, 1, None, None), (None, 1, "user", "> a\nx "), (None, 1, "user", "> a\nx "), (3, None, "user", "y"), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op4_quotation_linking"](spark, str(tmp_path))
    plain = reply_order(spark.createDataFrame([r for r in rows if r[0] == 1], "conv_id long, turn long, role string, text string"))
    assert got.dtypes == plain.dtypes
    assert sorted(got.where("conv_id = 1").collect()) == sorted(plain.collect())
    second = sorted(got.where("conv_id = 2").collect(), key=lambda r: r.position)
    assert [(r.turn, r.role, r.text, r.parent_turn, r.quotes, r.root_turn, r.position) for r in second] == [
        (0, "assistant", "It is this.", None, False, 0, 0), (1, "user", "Why?", 0, True, 1, 1),
        (0, "user", "What is it?", 0, False, 0, 2), (0, "user", "What is it?", 0, False, 0, 3), (1, None, "", 0, False, 0, 4),
    ]
    loose = got.where("conv_id is null or turn is null").collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text, r.n_quoted) for r in loose), key=str) == sorted(
        [(None, 1, "user", "x", 1), (None, 1, "user", "x", 1), (3, None, "user", "y", 0), (None, None, None, "", 0)], key=str
    )
    assert {(r.parent_turn, r.quotes, r.root_turn, r.position) for r in loose} == {(None, False, None, None)}
