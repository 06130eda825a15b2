"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only (operator 7)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewake.session import counted_save_point, save_point

SHINGLE = 5
SIMILARITY = 0.8
#: Shingle multisets at similarity 0.8 differ in about 10 of 64 fingerprint bits, with a deviation
#: of 3. So 23 bits lose none in practice, while unrelated texts are 32 bits apart.
RADIUS = 23
BLOCKS = 8
#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null and empty texts have none."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(spaced != "", F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def _grams(of: Column, size: Column, length: int, make) -> Column:
    starts = F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make([F.get(of, i + k) for k in range(length)]))


def shingle_hashes(of: Column, length: int) -> Column:
    return _grams(of, F.size(of), length, lambda parts: F.xxhash64(*parts))


def shingles(of: Column, length: int) -> Column:
    return _grams(of, F.size(of), length, lambda parts: F.concat_ws(" ", *parts))


def _by_length(of: Column, lengths: list[int], make) -> Column:
    """``make`` with the shingle length that an item of ``n`` words has: five, or all its words if fewer."""
    out = F.array().cast("array<bigint>" if make is shingle_hashes else "array<string>")
    for length in lengths:
        out = F.when(F.least(F.col("n"), F.lit(SHINGLE)) == length, make(of, length)).otherwise(out)
    return out


def with_shingles(contents: DataFrame, lengths: list[int]) -> DataFrame:
    """``contents`` (``n``, ``content``) with ``shingles``, written, so that no later step makes them again."""
    split = contents.withColumn("w", F.split("content", " "))
    return save_point(split.select("n", "content", _by_length(F.col("w"), lengths, shingles).alias("shingles")))


def fingerprints(contents: DataFrame) -> DataFrame:
    """``n``, ``content``, ``fp`` of contents with ``shingles``: a bit is set if it is in over half of their hashes.

    A shingle counts as often as it occurs: that is its weight.
    """
    hashes = contents.select("n", "content", F.explode("shingles").alias("s")).select("n", "content", F.xxhash64("s").alias("h"))
    ones = [
        F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)
    ]
    counted = hashes.groupBy("n", "content").agg(F.count("*").alias("total"), *ones)
    bits = F.lit(0).cast("long")
    for b in range(64):
        mask = F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("total"), mask).otherwise(F.lit(0).cast("long")))
    return counted.select("n", "content", bits.alias("fp"))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255).cast("long"))


def hamming_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS, items_rows: int | None = None) -> DataFrame:
    """Pairs of a window and an item of as many words whose fingerprints differ in at most ``radius`` bits.

    ``radius`` bits over eight blocks leave some block with at most ``radius // 8``: each item is indexed
    under all values so near to each of its blocks, a window looks its own blocks up. No pair within the
    radius is lost; a pair that meets in several blocks is given from the first of them only.
    """
    near = radius // BLOCKS
    masks = [sum(1 << b for b in c) for size in range(near + 1) for c in combinations(range(8), size)]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    index = items.select(
        "n", F.col("content").alias("item"), F.col("fp").alias("item_fp"),
        F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"),
    )
    index = index.select(
        "n", "item", "item_fp", "block", F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    )
    if items_rows is not None and items_rows * BLOCKS * len(masks) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    looked_up = windows.select(
        "n", "content", "fp",
        F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"),
    )
    apart = F.expr("fp ^ item_fp")
    first = F.lit(None).cast("int")
    for b in reversed(range(BLOCKS)):
        first = F.when(F.bit_count(_block(apart, b)) <= near, F.lit(b)).otherwise(first)
    return (
        looked_up.join(index, ["n", "block", "value"])
        .where((F.bit_count(apart) <= radius) & (F.col("block") == first))
        .select("n", "content", "item", F.bit_count(apart).alias("bits"))
    )


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, each weighing as often as it occurs; null of two empty ones."""
    either_repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    common = F.array_intersect(a, b)
    least = F.aggregate(
        common,
        F.lit(0),
        lambda total, s: total + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))),
    )
    shared = F.when(either_repeats, least).otherwise(F.size(common))
    return F.try_divide(shared, F.size(a) + F.size(b) - shared)


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``bits``, ``n_windows``, ``start``: a row for each document
    and benchmark item that some window of the document repeats.

    A window has as many words as the item (the last ones of a text: as many as are left). It
    repeats the item if their fingerprints differ in at most ``radius`` bits and the weighted
    Jaccard similarity of their five-word shingles is ``threshold`` or more. ``similarity``, ``bits`` and ``start`` (a
    word number from 0) are those of the most similar window, the first if several are.

    Similar windows of L shingles have at most ``m = L (1 - threshold) / (1 + threshold)`` that the item
    lacks, so one of the first ``m + 1`` is the item's: only there windows start, all others have no
    chance. Equal texts and equal windows are handled once. Null and empty texts and items match
    nothing; an item under five words has one shingle, itself; repeated rows and items each get their rows; other
    columns are ignored.
    """
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("n"), F.concat_ws(" ", "w").alias("content"))
    items, seen = counted_save_point(items)
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    contents = items.select("n", "content").distinct()

    # Where windows may start: where a text has a shingle of an item, and up to m before.
    misses = F.floor((F.col("n") - F.least("n", F.lit(SHINGLE)) + 1) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    split = contents.select("n", F.split("content", " ").alias("w"))
    hashed = F.explode(_by_length(F.col("w"), lengths, shingle_hashes)).alias("h")
    anchors = split.select("n", misses.cast("int").alias("m"), hashed).distinct()
    anchors, anchor_counts = counted_save_point(anchors)
    if anchor_counts["rows"] <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    texts = docs.select("doc_id", "text", F.md5("text").alias("key"))
    grams = None
    for length in lengths:
        some = texts.select("key", words(F.col("text")).alias("w"))
        some = some.select("key", F.posexplode(shingle_hashes(F.col("w"), length)).alias("at", "h"))
        fitting = anchors.where(F.least("n", F.lit(SHINGLE)) == length)
        found = some.join(fitting, "h").select("key", "n", "at", "m")
        grams = found if grams is None else grams.unionByName(found)
    if grams is None:
        grams = texts.select("key", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("m")).where("false")
    before = F.transform(F.sequence(F.lit(0), F.col("m")), lambda j: F.greatest(F.col("at") - j, F.lit(0)))
    starts = save_point(grams.select("key", "n", F.explode(before).alias("start")).distinct())

    # The texts with such places, read once more; then their windows.
    keys, key_counts = counted_save_point(starts.select("key").distinct())
    if key_counts["rows"] <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    hit = save_point(texts.join(keys, "key").select("doc_id", "key", "text"))
    places = starts.groupBy("key").agg(F.collect_list(F.struct("n", "start")).alias("places"))
    once = hit.groupBy("key").agg(F.first("text").alias("text"))
    cut = once.join(places, "key").select("key", "places", words(F.col("text")).alias("w"))
    pieces = F.transform(
        "places",
        lambda p: F.struct(
            p["n"].alias("n"), p["start"].alias("start"),
            F.concat_ws(" ", F.slice(F.col("w"), p["start"] + 1, p["n"])).alias("content"),
        ),
    )
    windows = save_point(cut.select("key", F.explode(pieces).alias("p")).select("key", "p.*"))

    ours = with_shingles(windows.select("n", "content").distinct(), lengths)
    theirs = with_shingles(contents, lengths)
    pairs = save_point(hamming_pairs(fingerprints(ours), fingerprints(theirs), radius, seen["rows"]))
    theirs = theirs.select("n", F.col("content").alias("item"), F.col("shingles").alias("item_shingles"))
    if seen["rows"] <= BROADCAST_ROWS // 100:
        theirs = F.broadcast(theirs)
    pairs = pairs.join(ours, ["n", "content"]).join(theirs, ["n", "item"])
    pairs = pairs.withColumn("similarity", similarity(F.col("shingles"), F.col("item_shingles")))
    pairs = save_point(pairs.where(F.col("similarity") >= threshold).select("n", "content", "item", "bits", "similarity"))

    matched = windows.join(pairs, ["n", "content"]).groupBy("key", "item")
    matched = matched.agg(
        F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), (-F.col("bits")).alias("same"))).alias("best"),
        F.count("*").alias("n_windows"),
    )
    named = matched.join(items.select("item_id", F.col("content").alias("item")), "item")
    return hit.select("doc_id", "key").join(named, "key").select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.same")).cast("int").alias("bits"),
        "n_windows",
        (-F.col("best.back")).cast("int").alias("start"),
    )
