"""Language identification by rank-order profiles of character n-grams (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from tablewake.llm.arrow import add_columns

#: N-grams in a profile, of a language and of a document.
TOP = 400
#: Documents that a language's profile is learned from.
SAMPLE_ROWS = 1_500
#: The first pass of the sampling splits each language so often.
SAMPLE_PARTS = 64
UNKNOWN = "und"
_NONE = np.uint64(0x1FFFFF)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to 3-grams of the lower-cased words of a whole text.

    A word is a run of letters, with one blank on either side. A key holds three code points of 21 bits.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0)
    kept = np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])[: len(codes)] if len(codes) else codes
    c = np.concatenate([[0], codes[kept == 1], [0]]).astype(np.uint64) if len(codes) else np.zeros(1, np.uint64)
    a, b = c << np.uint64(42), c << np.uint64(21)
    one = (a | (_NONE << np.uint64(21)) | _NONE)[c != 0]
    two = (a[:-1] | b[1:] | _NONE)[(c[:-1] != 0) | (c[1:] != 0)]
    three = (a[:-2] | b[1:-1] | c[2:])[c[1:-1] != 0] if len(c) > 2 else one
    if not len(one):
        return one, np.zeros(0, np.int64)
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def profile(text: str | None, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, equals by key."""
    keys, counts = ngrams(text)
    return keys[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """The profiles of all languages side by side: a row of ranks for each n-gram that any of them has."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP) -> None:
        self.names, self.top = sorted(ranked), top
        self.keys = np.unique(np.array([k for keys in ranked.values() for k in keys], np.uint64))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            at = np.searchsorted(self.keys, np.array(ranked[name], np.uint64))
            self.ranks[at, column] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least out-of-place distance, and 1 less that distance over the largest possible.

        An n-gram that a language's profile lacks counts as ``top`` places away. Of equal distances the
        first name wins. Without a letter, or without a profile, the language is unknown and the score 0.
        """
        own = profile(text, self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.top * len(own)))


def learn(docs: DataFrame, may_learn: Column, rows: int = SAMPLE_ROWS, top: int = TOP) -> Profiles:
    """Profiles from the whole texts of at most ``rows`` documents of each ``lang``, in the order of a hash of their
    ids; rows without a language, a text or ``may_learn`` teach nothing.

    The ids are cut down in parts before each language's parts meet, n-grams are counted in the tasks that
    hold the texts, and only the profiles come to the driver.
    """
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id"]
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PARTS))
    first = Window.partitionBy("lang", part).orderBy(*order)
    all_parts = Window.partitionBy("lang").orderBy(*order)
    few = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows)
    few = few.withColumn("n", F.row_number().over(all_parts)).where(F.col("n") <= rows)
    picked = few.select("doc_id", "lang").distinct()
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, parts in seen.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                total = np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(total)],
                    names=["lang", "key", "n"],
                )

    counts = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, rank, key in ranked.select("lang", "rank", "key").collect():
        found.setdefault(lang, []).append((rank, key))
    return Profiles({lang: [key for _, key in sorted(keys)] for lang, keys in found.items()}, top)


def add_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of each whole text; only the text decides.

    Null texts and texts without a letter are ``und`` with score 0. Columns named like the added ones are
    replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(texts: pa.Array) -> list[pa.Array]:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return add_columns(docs, ["text"], [StructField("lang_pred", StringType()), StructField("score", DoubleType())], work)
