"""SimHash near-dedup over an inverted index of positional bytes (operator 9)."""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tablewake.llm.arrow import add_columns
from tablewake.llm.components import connected_components
from tablewake.session import save_point

SEED = 42
HASHES_AT_ONCE = 65_536

#: The sets of four byte positions whose numbers xor to zero: a Steiner system S(3,4,8). Any three
#: positions lie in one set, and the rest of each set is a set again. So two fingerprints that differ
#: in at most three positions agree on the whole of some set.
POSITION_SETS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)
#: Likewise for the eight half bytes that a set leaves open: at most three differ, some five agree.
HALF_SETS = tuple(combinations(range(8), 5))
MAX_BITS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long.

    A-Z is lower-cased, words are runs of anything but the six ASCII spaces, shingles count as often as they
    occur and hash by XXH64 with seed 42; a bit is set if it is in over half the hashes. Fewer words
    than a shingle: the whole sequence is the one shingle. No word, or null: zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts)), repeat(SEED))
    ones, total = np.zeros(64, np.int64), 0
    while len(some := np.fromiter(islice(hashes, HASHES_AT_ONCE), "<u8")):
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def add_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a long."""

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())]

    return add_columns(docs, [text], [StructField(to, LongType())], work)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _half(fp: Column, at: Column, k: int) -> Column:
    """Half byte ``k`` of the four bytes that the set ``at`` of position lists leaves open."""
    shift = F.get(at, F.lit(k // 2)) * 8 + 4 * (k % 2)
    return F.call_function("shiftrightunsigned", fp, shift.cast("int")).bitwiseAND(F.lit(15).cast("long"))


def _packed(parts: list[Column], width: int) -> Column:
    out = F.lit(0).cast("long")
    for part in parts:
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = 1024) -> DataFrame:
    """``a < b``: all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits.

    With at most three bits apart, at least five of the eight positional bytes match. Lists of single
    bytes would each hold 1/256 of all rows, so the index is kept by the sets of four matching bytes
    that any such pair must share one of (`POSITION_SETS`). Pairs that meet there have their
    shared positional bytes counted, stay if they reach the guaranteed minimum, and are verified on
    all bits. A list longer than ``bucket`` is indexed once more by five of the eight half bytes it leaves
    open, after which no list can hold more than 4,096 fingerprints: no cap, no lost pair, and no
    group whose size grows with the data.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits is 0 to {MAX_BITS}: beyond, the position sets guarantee nothing")
    fp = F.col("fp")
    keys = [
        _packed([F.lit(i).cast("long"), _packed([_byte(fp, p) for p in at], 8)], 32)
        for i, at in enumerate(POSITION_SETS)
    ]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save_point(postings.join(lists, "key"))

    open_positions = F.array(
        *[F.array(*[F.lit(p) for p in range(8) if p not in at]) for at in POSITION_SETS]
    )
    at = F.get(open_positions, F.shiftright("key", 32).cast("int"))
    halves = F.array(*[_half(fp, at, k) for k in range(8)])
    sets = F.array(*[F.array(*[F.lit(k) for k in at5]) for at5 in HALF_SETS])
    finer = F.transform(
        sets,
        lambda at5, i: _packed(
            [(i + 1).cast("long"), _packed([F.get("halves", F.get(at5, F.lit(k))) for k in range(5)], 4)], 20
        ),
    )
    small = shared.where(F.col("n") <= bucket).select("key", F.lit(0).cast("long").alias("key2"), "fp")
    large = (
        shared.where(F.col("n") > bucket)
        .select("key", "fp", halves.alias("halves"))
        .select("key", F.explode(finer).alias("key2"), "fp")
    )
    index = small.unionByName(large)

    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    differing = F.expr("a ^ b")
    matches = sum((F.when(_byte(differing, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    return (
        a.join(b, ["key", "key2"])
        .where(F.col("a") < F.col("b"))
        .where(matches >= 8 - max_bits)
        .where(F.bit_count(differing) <= max_bits)
        .select("a", "b")
        .distinct()
    )


def simhash_groups(
    docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, bucket: int = 1024, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for each row of ``docs``.

    Documents link if their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the
    smallest id reachable over links, the own one included. Equal fingerprints are one node, so copies cost
    no links. Texts without a word, and null texts, have fingerprint zero and link as such. A null id never
    names a component unless all its rows have none; repeated rows are given as often as they come; other
    columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    marked = save_point(add_fingerprint(rows, shingle).select("doc_id", "fp"))
    nodes = save_point(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), max_bits, bucket))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp", "left").select("doc_id", digits.alias("fingerprint"), "component_id")
