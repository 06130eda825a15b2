"""Volatile tables replaced by the tables they were loaded from."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import trim_strings
from ..session import counted_save_point, gathered, save_point, short_tables_together

RELATION_COLUMNS = (
    "script_file",
    "child_table_name",
    "relationship",
    "parent_table_name",
    "child_table_type",
    "parent_table_type",
)
TRAIL_SEPARATOR = " | "
#: Steps of a loop that run as one job, at first and at most; in between their number doubles.
FIRST_BATCH, LAST_BATCH = 4, 8
#: Rows that one task works on by itself.
TOGETHER = 250_000


def require_columns(df: DataFrame, columns: Sequence[str] = RELATION_COLUMNS) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def relabel(relations: DataFrame) -> DataFrame:
    kind = F.when(F.upper("relationship") == "DELETE", "DELETE").otherwise("Loaded From")
    return relations.withColumn("relationship", kind)


def prepare_relations(relations: DataFrame) -> DataFrame:
    return relabel(trim_strings(require_columns(relations).dropDuplicates()))


def is_volatile(table_type: str) -> Column:
    return F.coalesce(F.col(table_type) == "VOLTABLE", F.lit(False))


def volatile_map(prepared: DataFrame) -> DataFrame:
    """What each volatile table is loaded from: one row per distinct parent, type and script.

    Kept as rows, not as one set per table, since a table may have any number of definitions.
    """
    return (
        prepared.where(is_volatile("child_table_type") & F.col("child_table_name").isNotNull())
        .select(
            F.col("child_table_name").alias("volatile_table"),
            "parent_table_name",
            "parent_table_type",
            "script_file",
        )
        .dropDuplicates()
    )


def _together(rows: int) -> Callable[[DataFrame], DataFrame]:
    """What keeps a chain of joins over so few rows in one task, where merges need neither a shuffle nor a broadcast. More rows stay
    as they are."""
    return (lambda df: df.coalesce(1).hint("merge")) if rows < TOGETHER else (lambda df: df)


def _trimmed(links: DataFrame, rows: int, back: bool) -> tuple[DataFrame, int]:
    """The links to names from which walks of any length go on (``back``: from names that such walks lead to), and their number.

    A round keeps the names one link further along the walks, so a batch of rounds is a chain of joins with one written table.
    """
    one, other = ("table", "next") if back else ("next", "table")
    # Of many links one round tells whether any go.
    rounds, before = FIRST_BATCH if rows < TOGETHER else 1, None
    while rows and rows != before:
        kept = _together(rows)
        links = kept(links)
        names = links.select(one).distinct()
        for _ in range(rounds):
            names = kept(names.join(links, one).select(F.col(other).alias(one)).distinct())
        links, found = counted_save_point(links.join(names, one))
        rows, before, rounds = found["rows"], rows, min(2 * rounds, LAST_BATCH)
    return links, rows


def _greatest(links: DataFrame, rows: int, labels: DataFrame) -> DataFrame:
    """``name, label``: the greatest label of the names from which links lead to a name, its own included."""
    own = labels.select(F.col("name").alias("table"), F.col("name").alias("next"))
    ways, count = counted_save_point(links.select("table", "next").unionByName(own))
    together = _together(count["rows"])
    ways, labels = together(ways), together(labels)
    # Pairs need one round and one that finds nothing moved.
    moved, rounds = 1, FIRST_BATCH if count["rows"] < TOGETHER else 2
    while moved:
        labels = labels.select("name", "label", F.col("label").alias("before"))
        for _ in range(rounds):
            told = ways.join(labels.withColumnRenamed("name", "table"), "table")
            kept = F.max(F.when(F.col("table") == F.col("next"), F.col("before")))
            labels = together(told.groupBy(F.col("next").alias("name")).agg(F.max("label").alias("label"), kept.alias("before")))
        labels, found = counted_save_point(labels, moved=F.col("label") != F.col("before"))
        labels, moved, rounds = together(labels), found["moved"], min(2 * rounds, LAST_BATCH)
    return labels.select("name", "label")


def _names(links: DataFrame) -> DataFrame:
    end = lambda name: F.struct(F.col(name).alias("name"))
    return links.select(F.inline(F.array(end("table"), end("next")))).distinct()


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("next").alias("table"), F.col("table").alias("next"))


def _mutual_groups(links: DataFrame) -> DataFrame:
    """``name, component``: groups of names that links in both directions connect."""
    mutual, count = counted_save_point(links.join(_turned(links), ["table", "next"]))
    mutual = _together(count["rows"])(mutual)
    if not count["rows"]:
        return mutual.select(F.col("table").alias("name"), F.col("next").alias("component"))
    groups = _greatest(mutual, count["rows"], _names(mutual).select("name", F.col("name").alias("label")))
    return groups.withColumnRenamed("label", "component")


def _labelled_groups(links: DataFrame, rows: int) -> DataFrame:
    """``name, component`` of any cycles.

    Names of one component have the same greatest name before them and the same behind them, so links
    between names that differ in either lead out of a component and go. This repeats with another order until
    none goes. Then the greatest name of what is left connected gets to all of it and all of it gets there.
    """
    salt, before = 0, None
    while True:
        together = _together(rows)
        links = together(links)
        rank = F.struct(F.xxhash64("name", F.lit(salt)).alias("h"), F.col("name").alias("n"))
        labels = _names(links).select("name", rank.alias("label"))
        ends = [_greatest(some, rows, labels) for some in (links, _turned(links))]
        named = lambda of, k: ends[k].toDF(of, f"{of}_{k}")  # noqa: B023, E731
        joined = links.select("table", "next")
        for of in ("table", "next"):
            for k in (0, 1):
                joined = together(joined.join(together(named(of, k)), of))
        inside = joined.where("table_0 = next_0 AND table_1 = next_1")
        links, found = counted_save_point(inside.select("table", "next", F.col("table_0.n").alias("component")))
        before, rows, salt = rows, found["rows"], salt + 1
        if rows in (0, before):
            return links.select(F.col("next").alias("name"), "component").distinct()


def cycle_components(links: DataFrame) -> DataFrame:
    """``name, component``: the strongly connected components of two names or more.

    First all links go that no cycle leads to, or that lead to none. In what is left names linked both ways become
    one; that repeats, since longer cycles shrink to such pairs or to nothing. Only cycles that
    hold no such pair are labelled.
    """
    links, count = counted_save_point(links.select("table", "next").where("table <> next").distinct())
    links = _together(count["rows"])(links)
    rows, members = count["rows"], None
    while True:
        for back in (False, True):
            links, rows = _trimmed(links, rows, back)
        if not rows:
            break
        together = _together(rows)
        links = together(links)
        groups, found = counted_save_point(_mutual_groups(links))
        if not found["rows"]:
            groups, found = counted_save_point(_labelled_groups(links, rows))
            if not found["rows"]:
                break
        groups = together(groups)
        into = lambda of: groups.select(F.col("name").alias(of), F.col("component").alias(f"{of}_in"))  # noqa: B023, E731
        merged = together(links.join(into("table"), "table", "left")).join(into("next"), "next", "left")
        merged = merged.select(F.coalesce("table_in", "table").alias("table"), F.coalesce("next_in", "next").alias("next"))
        links, count = counted_save_point(merged.where("table <> next").distinct())
        if members is not None:
            carried = members.join(into("component"), "component", "left")
            carried = carried.select("name", F.coalesce("component_in", "component").alias("component"))
            groups = carried.unionByName(groups.join(members, "name", "left_anti"))
        members, rows = save_point(groups), count["rows"]
    if members is None:
        return links.select(F.col("next").alias("name"), F.col("table").alias("component")).where(F.lit(False))
    return members


def _one_further(states: DataFrame, hops: DataFrame, depth: int) -> DataFrame:
    """The states, and those one link further than the ones of ``depth``. Names passed are kept as long as the component they lie
    in is not left. Each name has a hop to itself that keeps its states, so that many steps make one chain of joins."""
    again = F.coalesce(F.array_contains("passed", F.col("next")) | F.array_contains("faced", F.col("next")), F.lit(False))
    nothing = F.array().cast("array<string>")
    own = F.when(F.col("component").isNotNull(), F.array("next")).otherwise(nothing)
    passed = F.when(F.col("stays"), F.array_sort(F.array_union("passed", own))).otherwise(own)
    faced = F.when(F.col("two_faced"), F.array_sort(F.array_union("faced", F.array("next")))).otherwise(F.col("faced"))
    kept = lambda name, new: F.when(F.col("kept"), F.col(name)).otherwise(new).alias(name)
    return (
        states.join(hops, "table")
        .where(F.col("kept") | ((F.col("depth") == depth) & ~again))
        .select(
            "start",
            F.col("next").alias("table"),
            kept("passed", passed),
            kept("faced", faced),
            kept("trail", F.array_sort(F.array_union("trail", F.array("script")))),
            kept("depth", F.lit(depth + 1)),
        )
        .distinct()
    )


def volatile_closure(definitions: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Non-volatile ancestors of the volatile tables in ``starts``, over all simple paths.

    Returns ``start, parent_table_name, parent_table_type, trail`` (sorted array of the scripts on the
    way), distinct. Each start is walked once however many edges lead to it. A step joins the
    states with the volatile-to-volatile links only; the exits to other tables are joined once, at the
    end. Of the names passed, a state keeps those that could come again, as a sorted set: the ones in the
    strongly connected component it is in, until it leaves that. So paths that differ in nothing else
    merge, and without cycles no path is kept at all.
    """
    table = F.col("volatile_table")
    to_volatile = is_volatile("parent_table_type")
    exits = definitions.where(~to_volatile)
    links = definitions.where(to_volatile & (F.col("parent_table_name") != table)).select(
        table.alias("table"), F.col("parent_table_name").alias("next"), F.col("script_file").alias("script")
    )
    defined = definitions.select(table.alias("next")).distinct()
    links = links.join(defined, "next")
    # A name that some rows call volatile and others do not ends a path that has passed it, too.
    two_faced = exits.select(F.col("parent_table_name").alias("next")).distinct().join(defined, "next")
    two_faced = two_faced.withColumn("two_faced", F.lit(True))
    components, found = counted_save_point(cycle_components(links))
    components = _together(found["rows"])(components)
    stay = defined.select("next", F.col("next").alias("table"), F.lit(None).cast("string").alias("script"), F.lit(True).alias("kept"))
    ends = lambda of, c: components.select(F.col("name").alias(of), F.col("component").alias(c))
    steps, size = counted_save_point(links.withColumn("kept", F.lit(False)).unionByName(stay))
    together = _together(size["rows"])
    steps = together(together(together(steps).join(ends("table", "before"), "table", "left")).join(ends("next", "component"), "next", "left"))
    hops, size = counted_save_point(
        steps.join(two_faced, "next", "left").select(
            "table", "next", "script", "kept", "component",
            F.coalesce(F.col("before") == F.col("component"), F.lit(False)).alias("stays"),
            F.coalesce("two_faced", F.lit(False)).alias("two_faced"),
        )
    )
    starts, count = counted_save_point(starts.distinct())
    hops = gathered(hops, size["rows"])
    together = _together(max(size["rows"], count["rows"]))
    starts = together(starts)
    nothing = F.array().cast("array<string>")
    level = (
        together(together(starts.join(defined.withColumnRenamed("next", "start"), "start")).join(ends("start", "component"), "start", "left"))
        .join(two_faced.withColumnRenamed("next", "start"), "start", "left")
        .select(
            "start",
            F.col("start").alias("table"),
            F.when(F.col("component").isNotNull(), F.array("start")).otherwise(nothing).alias("passed"),
            F.when(F.col("two_faced"), F.array("start")).otherwise(nothing).alias("faced"),
            nothing.alias("trail"),
        )
    )
    level, found = counted_save_point(level.withColumn("depth", F.lit(0)))
    states, depth, levels = None, 0, FIRST_BATCH
    while True:
        # Few states go to one task only where the hops are few as well: they would follow the states there.
        level = gathered(level, max(found["rows"], size["rows"]))
        for _ in range(levels):
            level = _one_further(level, hops, depth)
            depth += 1
        batch, found = counted_save_point(
            level, deepest=F.col("depth") == depth, too_deep=F.col("depth") > (depth if max_depth is None else max_depth)
        )
        if found["too_deep"]:
            raise RuntimeError(f"volatile tables nest deeper than {max_depth}")
        states = batch if states is None else states.unionByName(batch)
        if not found["deepest"]:
            break
        level = batch.where(F.col("depth") == depth)
        # States may grow at each step; a batch that begins with many takes few.
        levels = min(2 * levels, LAST_BATCH) if found["rows"] < TOGETHER else FIRST_BATCH
    passed = F.coalesce(F.array_contains("faced", F.col("parent_table_name")), F.lit(False))
    return (
        states.drop("depth")
        .distinct()
        .join(exits.withColumnRenamed("volatile_table", "table"), "table")
        .where(~passed)
        .select(
            "start",
            "parent_table_name",
            "parent_table_type",
            F.array_sort(F.array_union("trail", F.array("script_file"))).alias("trail"),
        )
        .distinct()
    )


def resolve_volatile(relations: DataFrame, max_depth: int | None = None, prepared: bool = False) -> DataFrame:
    """Edges between non-volatile tables, with the trail of scripts in ``script_file``.

    ``max_depth`` raises when exceeded; it never cuts the result. The relations are read several
    times; pass them as ``prepared`` only when they are a written table of prepared rows.
    """
    relations = relations if prepared else save_point(prepare_relations(relations))
    roots = relations.where(~is_volatile("child_table_type"))
    direct = roots.where(~is_volatile("parent_table_type"))
    through = roots.where(is_volatile("parent_table_type")).select(*RELATION_COLUMNS)
    definitions, found = counted_save_point(volatile_map(relations))
    definitions = _together(found["rows"])(definitions)
    starts = through.where(F.col("parent_table_name").isNotNull()).select(
        F.col("parent_table_name").alias("start")
    ).distinct()
    with short_tables_together(relations.sparkSession):
        closure = volatile_closure(definitions, starts, max_depth)
    trail = F.array_sort(F.array_union(F.array("script_file"), F.col("trail")))
    resolved = (
        through.drop("parent_table_type")
        .withColumnRenamed("parent_table_name", "start")
        .join(closure, "start")
        .withColumn("script_file", F.array_join(trail, TRAIL_SEPARATOR))
        .select(*RELATION_COLUMNS)
    )
    return direct.unionByName(resolved, allowMissingColumns=True).dropDuplicates()


def sort_relations(relations: DataFrame) -> DataFrame:
    """By child and parent, nulls last. The other columns break ties, so that the range partitions of a
    sort can split a child or parent that has very many rows."""
    first = ["child_table_name", "parent_table_name"]
    rest = [c for c in relations.columns if c not in first]
    return relations.orderBy(*[F.col(c).asc_nulls_last() for c in [*first, *rest]])
