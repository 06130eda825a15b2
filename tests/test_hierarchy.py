"""Hierarchy and flattening, with nulls, against plain outer joins."""

import random

import pytest

from tablewake.operators import hierarchy as H
from tablewake.operators.reports import hierarchy_statistics, join_statistics

from .conftest import rows

SCHEMA = "child_table_name string, relationship string, parent_table_name string, parent_table_type string"


def outer_joins(data):
    """Full outer joins level by level; a null key matches a null key."""
    tables = [[(p, c) for c, _, p, t in data if t == name] for name in H.LEVELS]
    paths = tables[0]
    for depth, table in enumerate(tables[1:], start=1):
        joined = []
        for path in paths:
            matches = [(path + (c,)) for p, c in table if p == path[-1]]
            joined += matches or [path + (None,)]
        ends = {path[-1] for path in paths}
        joined += [(None,) * depth + row for row in table if row[0] not in ends]
        paths = joined
    return sorted(paths, key=lambda r: tuple((v is None, str(v)) for v in r))


def made(seed, null_parents):
    rng = random.Random(seed)
    data = []
    for depth, name in enumerate(H.LEVELS):
        for _ in range(rng.randint(2, 6)):
            parent = None if null_parents and rng.random() < 0.15 else f"n{depth}_{rng.randint(0, 4)}"
            child = None if rng.random() < 0.1 else f"n{depth + 1}_{rng.randint(0, 4)}"
            data.append((child, "in", parent, name))
    for i in range(6):
        data.append((rng.choice([None, f"n8_{i}"]), "Loaded From", rng.choice([None, f"n8_{i % 4}"]), rng.choice([None, "TABLE"])))
    return data


@pytest.mark.parametrize("null_parents", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_paths_and_flattening(spark, seed, null_parents):
    data = made(seed, null_parents)
    df = spark.createDataFrame(data, SCHEMA)
    paths = H.build_hierarchy(df)
    expected = outer_joins(data)
    assert rows(paths) == expected
    edges = [(p, k, c) for c, k, p, t in data if t not in H.LEVELS]
    for match_nulls in (True, False):
        flat = []
        for parent, kind, child in edges:
            def owners(name):
                met = [path for path in expected if path[-1] == name and (match_nulls or name is not None)]
                return met or [(None,) * 8 + (name,)]
            flat += [p + (kind,) + c for p in owners(parent) for c in owners(child)]
        got = H.flatten_hierarchy(H.relationship_rows(df), paths, match_nulls, hot_rows=1 + seed % 2)
        assert rows(got) == sorted(flat, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_counts(spark):
    data = made(1, False)
    df = spark.createDataFrame(data, SCHEMA)
    counts = dict(rows(hierarchy_statistics(df)))
    assert counts["Relationship"] == 6 and sum(counts.values()) == len(data)
    assert dict(rows(join_statistics(df)))["Schema"] == len(outer_joins(data))


@pytest.mark.parametrize("seed", range(2))
def test_counts_without_joins(spark, seed):
    df = spark.createDataFrame(made(seed, True), SCHEMA)
    joined = {name: H.hierarchy_by_full_joins(df, H.LEVELS[: d + 1]).count() for d, name in enumerate(H.LEVELS) if d}
    assert dict(rows(join_statistics(df))) == joined


def test_plans(spark):
    """One inner join a level, no full join; counts read what each level wrote."""
    df = spark.createDataFrame(made(2, True), SCHEMA)
    plan = H.build_hierarchy(df)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Join") == 7 and plan.count("Exchange") <= 20
    assert join_statistics(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8


def test_a_hot_name_is_spread(spark):
    """A name on 30% of the edges is joined in parts."""
    edges = spark.createDataFrame(
        [("hot" if i % 10 < 3 else f"p{i}", "Loaded From", f"c{i}") for i in range(3000)],
        "ParentObjectName string, InternalRelationship string, ChildObjectName string",
    )
    owners = spark.createDataFrame([(*["x"] * 8, "hot"), (*["y"] * 8, "c1")], ", ".join(f"{n} string" for n in H.NAMES))
    hot = {r._hot: r.salts for r in H._hot_names(edges, "ParentObjectName", 100).collect()}
    assert hot == {"hot": 9}
    flat = H.flatten_hierarchy(edges, owners, hot_rows=100)
    assert flat.count() == 3000 and flat.where("ParentSector = 'x'").count() == 900 and flat.where("ChildSector = 'y'").count() == 1
