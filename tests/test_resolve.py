"""The closure against a plain walk over all simple paths."""

import random

import pytest

from tablewake.operators import reports
from tablewake.operators import resolve as R

from .conftest import rows

SCHEMA = ", ".join(f"{c} string" for c in R.RELATION_COLUMNS)


def relations(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def edge(script, child, parent, child_type="VOLTABLE", parent_type="VOLTABLE", kind="INSERT"):
    return (script, child, kind, parent, child_type, parent_type)


def walked(data):
    """By definition: of all sequences of distinct volatile tables that links join, those that lead to an end."""
    links, ends = {}, {}
    for script, child, _, parent, child_type, parent_type in data:
        if child_type == "VOLTABLE":
            (links if parent_type == "VOLTABLE" else ends).setdefault(child, []).append((parent, parent_type, script))
    out = set()
    for script, child, kind, parent, child_type, parent_type in data:
        if child_type == "VOLTABLE":
            continue
        relation = "DELETE" if kind.upper() == "DELETE" else "Loaded From"
        if parent_type != "VOLTABLE":
            out.add((script, child, relation, parent, child_type, parent_type))
            continue
        sequences = [((parent,), frozenset([script]))]
        while sequences:
            longer = []
            for path, scripts in sequences:
                for end, end_type, last in ends.get(path[-1], []):
                    if end not in path:
                        out.add((" | ".join(sorted(scripts | {last})), child, relation, end, child_type, end_type))
                for name, _, by in links.get(path[-1], []):
                    if name not in path:
                        longer.append(((*path, name), scripts | {by}))
            sequences = longer
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def random_graph(seed):
    """Cycles, undefined tables, names of two types; every name carries the seed."""
    rng = random.Random(seed)

    def volatile(last):
        return f"g{seed}v{rng.randint(0, last)}"

    data = []
    for _ in range(28):
        script, child, chance = f"s{rng.randint(0, 3)}", volatile(9), rng.random()
        if chance < 0.25:
            data.append(edge(script, child, f"t{rng.randint(0, 4)}", parent_type=rng.choice(["TABLE", "VIEW", None])))
        elif chance < 0.35:
            data.append(edge(script, child, volatile(9), parent_type="TABLE"))
        else:
            data.append(edge(script, child, volatile(11)))
    for i in range(8):
        data.append(edge(f"r{i % 3}", f"g{seed}rpt{i}", volatile(10), "VIEW", kind=rng.choice(["Delete", "INSERT"])))
    return data + [edge("r", "rpt", None, "TABLE", None), edge("r", "rpt", "t1", "TABLE", "TABLE"), edge("r", "rpt", None, "TABLE")]


def test_random_graphs(spark):
    data = [row for seed in range(12) for row in random_graph(seed)]
    assert rows(R.resolve_volatile(relations(spark, data)), *R.RELATION_COLUMNS) == walked(data)


CASES = {
    "self loop": [edge("a", "v", "v"), edge("b", "v", "t", parent_type="TABLE")],
    "two-node cycle": [edge("a", "v", "w"), edge("b", "w", "v"), edge("c", "w", "t", parent_type="TABLE")],
    "no definition": [edge("a", "v", "w")],
    "two paths, two scripts": [
        edge("a", "v", "w"), edge("b", "v", "x"),
        edge("c", "w", "t", parent_type="TABLE"), edge("c", "x", "t", parent_type="TABLE"),
    ],
    "deep chain": [edge("a", f"v{'' if i == 0 else i}", f"v{i + 1}") for i in range(8)] + [edge("a", "v8", "t", parent_type="VIEW")],
}


def test_cases(spark):
    data = []
    for name, case in CASES.items():
        own = lambda table: table if table == "t" else f"{name} {table}"  # noqa: B023, E731
        data += [(s, own(c), k, own(p), ct, pt) for s, c, k, p, ct, pt in [*case, edge("root", "rpt", "v", "TABLE")]]
    got = rows(R.resolve_volatile(relations(spark, data)), *R.RELATION_COLUMNS)
    assert got == walked(data)
    ends = {name: [r[0] for r in got if r[1].startswith(name)] for name in CASES}
    assert ends == {
        "self loop": ["b | root"],
        "two-node cycle": ["a | c | root"],
        "no definition": [],
        "two paths, two scripts": ["a | c | root", "b | c | root"],
        "deep chain": ["a | root"],
    }


def test_layers_stay_small(spark):
    """Ten full layers of six tables hold six to the tenth paths, but one trail: no path is kept."""
    data = [
        edge("s", f"v{layer}_{i}", f"v{layer + 1}_{j}") for layer in range(10) for i in range(6) for j in range(6)
    ] + [edge("s", f"v10_{i}", "t", parent_type="TABLE") for i in range(6)]
    data += [edge("root", "rpt", "v0_0", "TABLE")]
    assert rows(R.resolve_volatile(relations(spark, data)), "script_file", "parent_table_name") == [("root | s", "t")]


def test_components(spark):
    rng = random.Random(9)
    links = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(55)}
    links |= {(f"c{i}", f"c{(i + 1) % 12}") for i in range(12)} | {("c3", "n1"), ("n2", "c5")}
    reach = {a: {a} for pair in links for a in pair}
    for _ in reach:
        for a, b in links:
            reach[a] |= reach[b]
    got = {}
    for r in R.cycle_components(spark.createDataFrame(sorted(links), "table string, next string")).collect():
        got.setdefault(r.component, set()).add(r.name)
    want = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}
    assert {frozenset(names) for names in got.values()} == {c for c in want if len(c) > 1}


def test_number_of_jobs(spark):
    """Pairs that load each other, chained: a job holds many steps, so jobs stay few."""
    data = [edge("s", f"{a}{d}", f"{b}{d}") for d in range(12) for a, b in ("vw", "wv")]
    data += [edge("s", f"w{d}", f"v{d + 1}") for d in range(11)] + [edge("s", "v11", "t", parent_type="TABLE"), edge("r", "rpt", "v0", "TABLE")]
    group = "number of jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert R.resolve_volatile(relations(spark, data)).count() == 1
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_depth_limit_raises(spark):
    data = [*CASES["deep chain"], edge("root", "rpt", "v", "TABLE")]
    with pytest.raises(RuntimeError, match="deeper than 3"):
        R.resolve_volatile(relations(spark, data), max_depth=3)
    assert R.resolve_volatile(relations(spark, data), max_depth=8).count() == 1


def test_extra_columns_of_direct_rows_stay(spark):
    df = relations(spark, [edge("a", "v", "t", parent_type="TABLE"), edge("b", "r", "v", "VIEW"), edge("c", "r", "u", "VIEW", "TABLE")])
    got = R.resolve_volatile(df.selectExpr("*", "'n' AS note"))
    assert rows(got, "parent_table_name", "note") == [("t", None), ("u", "n")]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="child_table_type, script_file"):
        R.require_columns(relations(spark, []).drop("script_file", "child_table_type"))


def test_sort_puts_nulls_last(spark):
    data = [edge("s", None, "a"), edge("s", "b", None), edge("s", "b", "a"), edge("s", "a", "z")]
    got = [(r.child_table_name, r.parent_table_name) for r in R.sort_relations(relations(spark, data)).collect()]
    assert got == [("a", "z"), ("b", "a"), ("b", None), (None, "a")]


def test_statistics(spark):
    data = [edge("a", "v", "t", parent_type="TABLE"), edge("a", " v", "t", parent_type="TABLE"), edge("b", "r", "v", "VIEW"), edge("b", "r", "v", "VIEW")]
    prepared = R.prepare_relations(relations(spark, data))
    stats = reports.resolution_statistics(prepared, R.resolve_volatile(prepared, prepared=True))
    assert rows(stats) == [
        ("input_relationships", None, 3), ("input_type", "VIEW", 1), ("input_type", "VOLTABLE", 2),
        ("net_change", None, -2), ("output_relationships", None, 1), ("output_type", "VIEW", 1),
        ("relationships_removed", None, 2), ("volatile_tables", None, 1),
    ]


def test_random_graphs_as_long_tables(spark, monkeypatch):
    """Over tables too long for one task rounds are told in other numbers."""
    monkeypatch.setattr(R, "TOGETHER", 5)
    data = [row for seed in range(20, 23) for row in random_graph(seed)]
    assert rows(R.resolve_volatile(relations(spark, data)), *R.RELATION_COLUMNS) == walked(data)


def test_few_states_do_not_gather_many_hops(spark, monkeypatch):
    asked, gathered = [], R.gathered
    monkeypatch.setattr(R, "gathered", lambda df, rows: asked.append(rows) or gathered(df, rows))
    data = [edge("s", f"v{i}", f"v{i + 1}") for i in range(40)] + [edge("s", "v3", "t", parent_type="TABLE"), edge("r", "rpt", "v0", "TABLE")]
    assert rows(R.resolve_volatile(relations(spark, data)), *R.RELATION_COLUMNS) == walked(data)
    assert len(asked) > 1 and min(asked) >= 40
