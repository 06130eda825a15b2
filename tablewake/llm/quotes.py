"""Conversations in reply order, by linking quotations to the messages they come from (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewake.llm.ordering import with_running_sum
from tablewake.session import counted_save_point, save_point

#: A line that names the author of the quotation below it.
ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"

COLUMNS = ("conv_id", "turn", "role", "text", "parent_turn", "quotes", "root_turn", "position", "n_quoted")


def quoted_lines(messages: DataFrame) -> DataFrame:
    """The lines of all messages: ``conv_id``, ``turn``, ``no``, ``level`` (0: own), ``line`` (without quote marks), ``norm``.

    The level is the number of ``>`` marks a line begins with, spaces between them allowed. ``norm`` is lower case with
    single spaces. A line that names the author of a quotation on the next line has level -1.
    """
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("no", "raw"), F.split(F.coalesce("text", F.lit("")), "\r?\n").alias("all"))
    following = F.coalesce(F.get("all", F.col("no") + 1), F.lit(""))
    marks = F.regexp_extract("raw", r"^((?:\s*>)*)", 1)
    level = F.length(F.regexp_replace(marks, r"\s+", ""))
    names_author = (level == 0) & F.col("raw").rlike(ATTRIBUTION) & following.rlike(r"^\s*>")
    line = F.regexp_replace("raw", r"^(?:\s*>)+ ?", "")
    return lines.select(
        "conv_id", "turn", "no", F.when(names_author, -1).otherwise(level).alias("level"), line.alias("line"),
        F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")).alias("norm"),
    )


def _passages(lines: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``level``, ``h``, ``weight``: each line, and each run of lines of one level as a whole."""
    said = lines.where((F.col("level") >= 0) & (F.col("norm") != ""))
    single = said.select("conv_id", "turn", "level", F.xxhash64("norm").alias("h"), F.length("norm").alias("weight"))
    by_message = Window.partitionBy("conv_id", "turn").orderBy("no")
    starts = F.when(F.col("level") == F.lag("level").over(by_message), 0).otherwise(1)
    runs = said.withColumn("new", starts).withColumn("run", F.sum("new").over(by_message))
    whole = runs.groupBy("conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(F.struct("no", "norm"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["norm"]), " ")
    whole = whole.where(F.size("l") > 1).select("conv_id", "turn", "level", F.xxhash64(text).alias("h"), F.length(text).alias("weight"))
    return single.unionByName(whole)


def quotation_links(lines: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``parent_turn``, ``matched``: the earlier message that a message quotes.

    Quoted passages and own passages of the same conversation meet by the hash of their normalised text; a quoted
    one takes the latest earlier message that says it, found in one pass over the passages with that
    hash, so a line that everyone repeats makes no pairs. The message quoted at the outermost level wins
    that has most quoted characters, of equals the latest.
    """
    passages = _passages(lines).groupBy("conv_id", "turn", "level", "h").agg(F.max("weight").alias("weight"))
    own_turn = F.when(F.col("level") == 0, F.col("turn"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = passages.withColumn("source", F.max(own_turn).over(earlier)).where("level > 0 and source is not null")
    sums = found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("matched"))
    best = F.max(F.struct(-F.col("level"), "matched", "source")).alias("best")
    return sums.groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", F.col("best.source").alias("parent_turn"), F.col("best.matched").alias("matched")
    )


def _branch_paths(branches: DataFrame) -> DataFrame:
    """``conv_id``, ``root_turn``, ``path``: where to turn off, from the first message to the branch.

    Each round replaces a branch's nearest known ancestor by that one's, so rounds grow with the logarithm of the nesting.
    """
    turned = F.when(F.col("up").isNotNull(), F.array("parent_turn", "root_turn")).otherwise(F.array().cast("array<long>"))
    paths = branches.select("conv_id", "root_turn", "up", turned.alias("path"))
    paths, counts = counted_save_point(paths, open=F.col("up").isNotNull())
    while counts["open"]:
        above = paths.select("conv_id", F.col("root_turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("first"))
        longer = F.concat(F.coalesce("first", F.array().cast("array<long>")), "path")
        paths = paths.join(above, ["conv_id", "up"], "left").select("conv_id", "root_turn", F.col("next").alias("up"), longer.alias("path"))
        paths, counts = counted_save_point(paths, open=F.col("up").isNotNull())
    return paths.select("conv_id", "root_turn", "path")


def _has_marks() -> Column:
    return F.coalesce(F.col("text").contains(">"), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def own_text(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``text`` (the lines of level 0, trimmed), ``n_quoted`` (how many lines are quoted).

    Only messages with a quote mark are cut into lines.
    """
    plain = _trimmed(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"))
    unmarked = messages.where(~_has_marks()).select("conv_id", "turn", plain.alias("text"), F.lit(0).cast("long").alias("n_quoted"))
    lines = quoted_lines(messages.where(_has_marks()))
    own = lines.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("no", "line")))).alias("l"),
        F.count_if(F.col("level") > 0).alias("n_quoted"),
    )
    text = _trimmed(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return own.select("conv_id", "turn", text.alias("text"), "n_quoted").unionByName(unmarked)


def reply_order(messages: DataFrame) -> DataFrame:
    """Each message without its quotations, in the order of its conversation's replies.

    ``conv_id``, ``turn``, ``role``, ``text`` (own lines only, trimmed), ``parent_turn`` (the message it quotes; without
    a linked quotation: the one before it), ``quotes`` (whether a quotation was linked), ``root_turn``,
    ``position`` (in the conversation, from 0), ``n_quoted`` (quoted lines).

    A message that quotes an earlier one than the last opens a branch there; the messages after it
    follow it. ``root_turn`` is the first message of a message's branch. The order is the one of a walk
    through the replies: a message, then the branches that turn off at it, then what follows it.

    Of rows that repeat a conversation and turn one stays, the smallest by role and text. Rows without ``conv_id`` or
    ``turn`` are in no order and left out. Null texts are empty; other columns are ignored.
    """
    known = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
    known = known.agg(F.min(F.struct("role", "text")).alias("m"))
    known = save_point(known.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text"))
    own = own_text(known)
    # Messages are linked only in conversations where one has a quote mark.
    quoting = known.where(_has_marks()).select("conv_id").distinct()
    lines = quoted_lines(known.join(quoting, "conv_id", "left_semi"))
    one = F.lit(1).cast("long")
    counted = with_running_sum(known.select("conv_id", "turn", "role"), [F.col("conv_id"), F.col("turn")], rows=one)
    at = save_point(
        counted.select("conv_id", "turn", "role", F.col("rows_before").alias("at"))
        .join(quotation_links(lines), ["conv_id", "turn"], "left")
        .join(own, ["conv_id", "turn"])
    )
    before = at.select("conv_id", (F.col("at") + 1).alias("at"), F.col("turn").alias("last_turn"))
    opens = F.col("last_turn").isNull() | F.coalesce(F.col("parent_turn") < F.col("last_turn"), F.lit(False))
    linked = at.join(before, ["conv_id", "at"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted", "at", opens.alias("opens"),
        F.coalesce("parent_turn", "last_turn").alias("parent_turn"), F.col("parent_turn").isNotNull().alias("quotes"),
    )
    numbered = with_running_sum(linked, [F.col("at")], opened=F.col("opens").cast("long"))
    numbered = numbered.withColumn("branch", F.col("opened_before") + F.col("opens").cast("long"))
    roots = numbered.where("opens").select("branch", F.col("turn").alias("root_turn"))
    branched = save_point(numbered.drop("opened_before", "opened_total").join(roots, "branch").drop("branch"))
    parents = branched.select("conv_id", F.col("turn").alias("parent_turn"), F.col("root_turn").alias("up"))
    branches = branched.where("opens").select("conv_id", "root_turn", "parent_turn")
    paths = _branch_paths(branches.join(parents, ["conv_id", "parent_turn"], "left"))
    walk = branched.join(paths, ["conv_id", "root_turn"]).withColumn("walk", F.concat("path", F.array("turn")))
    ordered = with_running_sum(walk.drop("path"), [F.col("conv_id"), F.col("walk")], rows=one)
    begins = ordered.groupBy("conv_id").agg(F.min("rows_before").alias("begin"))
    return ordered.join(begins, "conv_id").select(
        "conv_id", "turn", "role", "text", "parent_turn", "quotes", "root_turn",
        (F.col("rows_before") - F.col("begin")).alias("position"), "n_quoted",
    )


def _copies(numbered: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, with a number ``no`` of its own; very many come in parts."""
    last, size = F.col("copies") - 1, F.lit(4096).cast("long")
    parts = numbered.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / size))))
    each = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * size, F.least(last, F.col("part") * size + size - 1))))
    return each.withColumn("no", F.col("rows_before") + F.col("copy")).drop("copies", "part", "copy", "rows_before", "rows_total")


def whole_reply_order(messages: DataFrame) -> DataFrame:
    """``reply_order`` of every message: several of one turn follow each other by role and text, and messages without
    ``conv_id`` or ``turn`` come along without links, ``root_turn`` and ``position``.

    Messages are numbered over all conversations and ordered as if the numbers were their turns. ``parent_turn`` and
    ``root_turn`` are the turns of the messages linked to, which may be the message's own if it shares its turn. Rows
    that repeat a message, its key, role and text, follow each other. A quotation is linked within its conversation only; one
    of another conversation's message is left out like any other.
    """
    some = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    counted = some.where(keyed).groupBy(*some.columns).agg(F.count("*").alias("copies"))
    numbered = _copies(with_running_sum(counted, order, rows=F.col("copies")))
    numbered = save_point(numbered)
    turns = numbered.select("no", F.col("turn").alias("named"))
    ordered = reply_order(numbered.select("conv_id", F.col("no").alias("turn"), "role", "text"))
    # First messages have no parent: keys that match nothing keep them apart.
    ordered = ordered.withColumn("parent_turn", F.coalesce("parent_turn", -1 - F.col("turn")))
    for column in ("turn", "parent_turn", "root_turn"):
        named = turns.withColumnRenamed("no", column)
        ordered = ordered.join(named, column, "left").drop(column).withColumnRenamed("named", column)

    loose = save_point(some.where(~keyed).withColumn("no", F.monotonically_increasing_id()))
    unkeyed = loose.select(F.lit(None).cast(some.schema["conv_id"].dataType).alias("conv_id"), F.col("no").alias("turn"), "text")
    own = own_text(unkeyed).select(F.col("turn").alias("no"), "text", "n_quoted")
    loose = loose.drop("text").join(own, "no").withColumns(
        {"parent_turn": F.lit(None).cast("long"), "quotes": F.lit(False), "root_turn": F.lit(None).cast("long"), "position": F.lit(None).cast("long")}
    )
    return ordered.select(*COLUMNS).unionByName(loose.select(*COLUMNS))
