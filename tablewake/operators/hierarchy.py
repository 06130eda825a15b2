"""Ownership hierarchy: eight levels flattened to one row per path, then joined to both ends of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import spread_nulls
from ..session import counted_save_point, save_point
from .joins import FILLERS, left_join_even

# The levels from the top down, and the name of what the last one owns.
LEVELS = ("Sector", "Application", "Purpose", "Client", "Tool", "System", "SystemID", "Schema")
NAMES = (*LEVELS, "ObjectName")

#: Rows of a name that one task joins; a name with more is spread over as many salts as that takes.
HOT_ROWS = 200_000
#: Hot names that are sent to all tasks.
HOT_NAMES = 100_000


def level(df: DataFrame, name: str) -> DataFrame:
    """Rows whose parent is of one level: the parent, and the child one level down."""
    below = NAMES[LEVELS.index(name) + 1]
    return df.where(F.col("parent_table_type") == name).select(
        F.col("parent_table_name").alias(name), F.col("child_table_name").alias(below)
    )


def is_level_row() -> Column:
    return F.coalesce(F.col("parent_table_type").isin(*LEVELS), F.lit(False))


def relationship_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_level_row()).select(
        F.col("parent_table_name").alias("ParentObjectName"),
        F.col("relationship").alias("InternalRelationship"),
        F.col("child_table_name").alias("ChildObjectName"),
    )


def level_rows(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Rows of the levels as ``depth, parent, child``, with ``owned`` (the parent is a child one level up) and ``continued``
    (the child is a parent one level down), and how many of each kind there are.

    One aggregate over the names of all levels tells both, so no level is compared with another by itself.
    """
    depth = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.col("parent_table_type")).cast("int") - 1
    rows = df.where(is_level_row()).select(depth.alias("depth"), F.col("parent_table_name").alias("parent"), F.col("child_table_name").alias("child"))
    end = lambda depth, name, parent: F.struct(depth.alias("depth"), F.col(name).alias("name"), F.lit(parent).alias("is_parent"))
    ends = rows.select(F.inline(F.array(end(F.col("depth"), "parent", True), end(F.col("depth") + 1, "child", False)))).where("name IS NOT NULL")
    names = ends.groupBy("depth", "name").agg(F.max("is_parent").alias("continued"), F.max(~F.col("is_parent")).alias("owned"))
    above = names.where("owned").select("depth", F.col("name").alias("_parent"), "owned")
    below = names.where("continued").select((F.col("depth") - 1).alias("depth"), F.col("name").alias("_child"), "continued")
    known = rows.withColumns(
        {"_parent": spread_nulls(F.col("parent"), F.col("child")), "_child": spread_nulls(F.col("child"), F.col("parent"))}
    )
    known = known.join(above, ["depth", "_parent"], "left").join(below, ["depth", "_child"], "left").select(
        "depth", "parent", "child", F.coalesce("owned", F.lit(False)).alias("owned"), F.coalesce("continued", F.lit(False)).alias("continued")
    )
    of = lambda d, condition: (F.col("depth") == d) & condition
    return counted_save_point(
        known,
        partition_by=["depth"],
        **{f"no_parent_{d}": of(d, F.col("parent").isNull()) for d in range(len(LEVELS))},
        **{f"no_child_{d}": of(d, F.col("child").isNull()) for d in range(len(LEVELS))},
        **{f"ends_{d}": of(d, F.col("child").isNotNull() & ~F.col("continued")) for d in range(len(LEVELS))},
    )


def null_ends(found: dict[str, int]) -> list[bool]:
    """For each level, whether some path over the levels before it ends in a null name: a child without a name, or the blank behind
    a path that nothing continued."""
    out = [False]
    for d in range(1, len(LEVELS)):
        blank = d > 1 and (found[f"ends_{d - 2}"] > 0 or (out[d - 1] and not found[f"no_parent_{d - 1}"]))
        out.append(found[f"no_child_{d - 1}"] > 0 or blank)
    return out


def build_hierarchy(df: DataFrame) -> DataFrame:
    """Full outer join of the eight levels along their shared names; null names match each other.

    Whether a row's ends meet other rows is known from `level_rows`, so each level takes one inner join, which adaptive
    execution can split on a hot name: paths that go on meet their rows; those that do not, and null ends, meet filler
    rows by hash, where null ends find the rows without a parent if there are any. Rows without an owner start paths.
    """
    rows, found = level_rows(df)
    ends_in_null = null_ends(found)
    top = rows.where("depth = 0")
    paths = top.select(F.col("parent").alias(LEVELS[0]), F.col("child").alias(NAMES[1]), "continued")
    for d in range(1, len(LEVELS)):
        name, below = LEVELS[d], NAMES[d + 1]
        table = rows.where(F.col("depth") == d)
        key = _end_key(F.col(name), F.col("continued"), F.struct(*[c for c in paths.columns if c not in (name, "continued")]))
        started = table.where(~F.col("owned") & (F.col("parent").isNotNull() | F.lit(not ends_in_null[d])))
        started = started.select(F.col("parent").alias(name), F.col("child").alias(below), "continued")
        met = paths.withColumn("_key", key).drop("continued").join(_met_rows(table, found[f"no_parent_{d}"], below), "_key").drop("_key")
        paths = met.unionByName(started, allowMissingColumns=True)
    return paths.select(*NAMES)


def _end_key(name: Column, continued: Column, spread_by: Column) -> Column:
    filler = F.pmod(F.xxhash64(spread_by), F.lit(FILLERS)).cast("string")
    return F.when(name.isNull(), F.concat(F.lit("\0null"), filler)).when(continued, name).otherwise(F.concat(F.lit("\0end"), filler))


def _met_rows(table: DataFrame, no_parent: int, below: str) -> DataFrame:
    """``_key``, the child and ``continued``: a level's rows by parent, and what paths that end, or end in null, meet."""
    named = table.where("parent IS NOT NULL").select(F.col("parent").alias("_key"), F.col("child").alias(below), "continued")
    fillers = table.sparkSession.range(FILLERS).select(F.col("id").cast("string").alias("n"))
    blank = [F.lit(None).cast("string").alias(below), F.lit(False).alias("continued")]
    out = named.unionByName(fillers.select(F.concat(F.lit("\0end"), "n").alias("_key"), *blank))
    if not no_parent:
        return out.unionByName(fillers.select(F.concat(F.lit("\0null"), "n").alias("_key"), *blank))
    salts = F.transform(F.sequence(F.lit(0), F.lit(FILLERS - 1)), lambda n: F.concat(F.lit("\0null"), n.cast("string")))
    unnamed = table.where("parent IS NULL").select(F.explode(salts).alias("_key"), F.col("child").alias(below), "continued")
    return out.unionByName(unnamed)


def path_counts(df: DataFrame) -> list[DataFrame]:
    """``n``, the rows after each of the seven full outer joins, without the joins: paths are counted by the name they end in, and a
    row continues as many paths as end in its parent. Each level's counts are written, so that the next starts from them."""
    rows, found = level_rows(df)
    spark, many = df.sparkSession, "decimal(38,0)"

    def by_end(paths: DataFrame) -> DataFrame:
        # Paths that end in null, and rows without a parent, meet under one key; paths that end otherwise, under another.
        key = F.when(F.col("child").isNull(), "\0null").when(F.col("continued"), F.col("child")).otherwise("\0end")
        return save_point(paths.groupBy(key.alias("_key")).agg(F.sum("n").cast(many).alias("n")))

    ends = by_end(rows.where("depth = 0").select("child", "continued", F.lit(1).cast(many).alias("n")))
    totals = []
    for d in range(1, len(LEVELS)):
        table = rows.where(F.col("depth") == d).select(F.coalesce("parent", F.lit("\0null")).alias("_key"), "child", "continued")
        kinds = table.groupBy("_key", "child", "continued").agg(F.count("*").alias("rows"), F.lit(1).alias("least"))
        # What goes on without a row: nothing if there is no such path.
        blank = ["\0end"] if found[f"no_parent_{d}"] else ["\0end", "\0null"]
        blanks = spark.createDataFrame([(k, None, False, 1, 0) for k in blank], kinds.schema)
        met = kinds.unionByName(blanks).join(ends, "_key", "left")
        ends = by_end(met.select("child", "continued", (F.col("rows") * F.coalesce("n", F.col("least"))).cast(many).alias("n")))
        totals.append(ends.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")))
    return totals


def hierarchy_by_full_joins(df: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The joins as they read, over the first of the levels."""
    tables = [level(df, name) for name in levels]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        key = right.columns[0]
        right = right.withColumnRenamed(key, "_key")
        both = left.join(right, left[key].eqNullSafe(right["_key"]), "full")
        return both.withColumn(key, F.coalesce(key, "_key")).drop("_key")

    return reduce(joined, tables).select(*NAMES[: len(levels) + 1])


def _hot_names(edges: DataFrame, key: str, rows: int) -> DataFrame:
    """``_hot, salts``: the names that more than so many edges have, and how many salts these fill."""
    counts = edges.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    hot, found = counted_save_point(counts.select("_hot", F.ceil(F.col("n") / rows).cast("int").alias("salts")))
    return F.broadcast(hot) if found["rows"] <= HOT_NAMES else hot


def _attach(edges: DataFrame, hierarchy: DataFrame, side: str, by: str, hot: DataFrame, match_null_keys: bool) -> DataFrame:
    """Left join of edges with the hierarchy of the object on one side.

    ``hot``: names that very many edges have, the null name among them. An edge of such a name takes one of its salts, a
    hierarchy row all of them, so each pair still meets exactly once, but in several tasks.
    """
    key = f"{side}ObjectName"
    owned = hierarchy.toDF(*[f"{side}{name}" for name in NAMES])
    if not match_null_keys:
        owned = owned.where(F.col(key).isNotNull())
    salts, own = F.coalesce("salts", F.lit(1)), F.col("_hot").eqNullSafe(F.col(key))
    label = lambda salt: F.concat(F.coalesce(key, F.lit("\0null")), F.lit("\0s"), salt.cast("string"))
    other = F.struct(by, "InternalRelationship")
    salt = F.pmod(F.xxhash64(other), salts)
    edges = edges.join(hot, own, "left").withColumn("_name", label(salt)).drop("_hot", "salts")
    each = F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    owned = owned.join(hot, own, "left").select(*owned.columns, each).withColumn("_name", label(F.col("_salt"))).drop("_salt", key)
    return left_join_even(edges, owned, F.col("_name"), "_name", other)


def flatten_hierarchy(edges: DataFrame, hierarchy: DataFrame, match_null_keys: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Both ends of each edge with their eight owners (19 columns).

    With ``match_null_keys`` an end without a name matches every hierarchy path without an object, as null keys do in the
    tool this job stands in for; otherwise such ends have no owners. Each side's names are counted once, in a job of its own.
    """
    hot = {side: _hot_names(edges, f"{side}ObjectName", hot_rows) for side in ("Parent", "Child")}
    with_parent = _attach(edges, hierarchy, "Parent", "ChildObjectName", hot["Parent"], match_null_keys)
    both = _attach(with_parent, hierarchy, "Child", "ParentObjectName", hot["Child"], match_null_keys)
    return both.select(
        *[f"Parent{n}" for n in NAMES], "InternalRelationship", *[f"Child{n}" for n in NAMES]
    )
