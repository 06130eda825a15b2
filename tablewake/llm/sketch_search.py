"""Exact ranked search with hashed max-sketches (operator 11)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewake.session import save_point

TOP = 20
#: Coordinates of a document's sketch.
WIDTH = 2048
#: Documents whose sketches are held at a time, unless their texts are longer than so many bytes before.
CHUNK_DOCS, CHUNK_BYTES = 1024, 16_000_000
#: Items, and bytes of their texts, that are sent to all tasks at a time; more are dealt to several rounds.
ROUND_ITEMS, ROUND_BYTES = 2_000, 16_000_000
#: Partitions whose results are merged in a first step.
MERGED = 128
DOCUMENTS, TERMS = -1, -2

#: Each byte of a text in UTF-8: A to Z as a to z, what separates terms as a blank.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z in
    lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Items:
    """The queries of a round: their terms, numbered, and each query's terms with their repeats."""

    def __init__(self, ids: list, texts: list) -> None:
        self.ids = ids
        self.counts = [Counter(terms(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n: int, documents: int, all_terms: int) -> int:
    return 100 - 25 + 25 * n * documents // all_terms


def saturation(tf, factor):
    """What a term's occurrences in a document count for; for numbers and arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * factor)


class Searcher:
    """The best documents so far for each query of a round."""

    def __init__(self, items: Items, df: dict[int, int], documents: int, all_terms: int, top: int, width: int = WIDTH) -> None:
        self.number, self.documents, self.all_terms, self.top, self.width = items.number, documents, all_terms, top, width
        self.weight = np.array([term_weight(documents, df.get(i, 0)) for i in range(len(items.number))], np.int64)
        at = np.array([crc32(t) % width for t in items.number], np.int64)
        self.queries, lookup = [], np.zeros((width, len(items.counts)))
        for q, counts in enumerate(items.counts):
            some = np.array([items.number[t] for t in counts], np.int64)
            weights = self.weight[some] * np.fromiter(counts.values(), np.int64, len(counts))
            self.queries.append((some, weights))
            np.add.at(lookup[:, q], at[some], weights)
        self.lookup = lookup
        self.found: list[list[tuple]] = [[] for _ in items.counts]
        self.reach = np.zeros(len(items.counts))
        self.of_query = np.zeros(len(items.number), np.int64)
        self.rescored = self.seen = 0

    def add(self, ids: list, texts: list) -> None:
        """Take a chunk of documents in.

        Each document's impacts, of all its terms, are folded into a sketch: the greatest of each coordinate. Looked up with
        a query's weights, a sketch says at most what the document scores. The documents are scored exactly from the
        greatest such bound downwards, until no bound reaches the last of the best so far.
        """
        counts = [Counter(terms(t)) for t in texts]
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        factor = np.array([length_factor(c.total(), self.documents, self.all_terms) for c in counts], np.int64)
        doc = np.repeat(np.arange(len(counts)), sizes)
        tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(doc))
        impact = saturation(tf, factor[doc])
        at = np.fromiter((crc32(t) % self.width for c in counts for t in c), np.int64, len(doc))
        sketch = np.zeros((len(counts), self.width))
        np.maximum.at(sketch, (doc, at), impact)
        # A trace more than the sums, which are rounded for queries of very many terms.
        bounds = (sketch @ self.lookup) * (1 + 1e-9)
        known = np.fromiter((self.number.get(t, -1) for c in counts for t in c), np.int64, len(doc))
        asked = known >= 0
        known, impact = known[asked], impact[asked]
        edges = np.searchsorted(doc[asked], np.arange(len(counts) + 1))
        self.seen += bounds.size
        for q in np.flatnonzero((bounds >= self.reach).any(0) & (bounds > 0).any(0)):
            self._descend(q, bounds[:, q], ids, known, impact, edges)

    def _descend(self, q: int, bound: np.ndarray, ids: list, known: np.ndarray, impact: np.ndarray, edges: np.ndarray) -> None:
        some, weights = self.queries[q]
        self.of_query[some] = weights
        can = np.flatnonzero((bound >= self.reach[q]) & (bound > 0))
        can = can[np.argsort(-bound[can], kind="stable")]
        step = 2 * self.top
        while len(can) and bound[can[0]] >= self.reach[q]:
            now, can = can[:step], can[step:]
            now = now[bound[now] >= self.reach[q]]
            self.rescored += len(now)
            sizes = edges[now + 1] - edges[now]
            owner = np.repeat(np.arange(len(now)), sizes)
            places = np.arange(len(owner)) + np.repeat(edges[now] - np.cumsum(sizes) + sizes, sizes)
            score = np.zeros(len(now), np.int64)
            np.add.at(score, owner, self.of_query[known[places]] * impact[places])
            good = np.flatnonzero((score > 0) & (score >= self.reach[q]))
            best = self.found[q] + [(-int(score[i]), _place(ids[now[i]]), ids[now[i]]) for i in good]
            self.found[q] = sorted(best, key=lambda r: r[:2])[: self.top]
            if len(self.found[q]) == self.top:
                self.reach[q] = -self.found[q][-1][0]
            step *= 2
        self.of_query[some] = 0


def _place(id) -> tuple:
    """Ids in ascending order, null last."""
    return (id is None, 0 if id is None else id)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts in chunks of a bounded size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if len(ids) >= CHUNK_DOCS or size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def corpus_counts(rows: DataFrame, items) -> tuple[dict[int, int], int, int]:
    """In how many documents each of the queries' terms occurs, the documents with a term, and all terms with their repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number
        df, documents, all_terms = np.zeros(len(number), np.int64), 0, 0
        for _, texts in _texts(batches):
            hits: list[int] = []
            for text in texts:
                found = terms(text)
                documents += bool(found)
                all_terms += len(found)
                hits += [number[t] for t in number.keys() & set(found)] if len(number) < len(found) else [
                    number[t] for t in set(found) if t in number
                ]
            df += np.bincount(hits, minlength=len(number)) if hits else 0
        some = np.flatnonzero(df)
        columns = [np.append(some, [DOCUMENTS, TERMS]), np.append(df[some], [documents, all_terms])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "n"])

    counted = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(*[counted.column(c).to_pylist() for c in ("term", "n")]))
    documents, all_terms = found.pop(DOCUMENTS, 0), found.pop(TERMS, 0)
    return found, documents, all_terms


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, id: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: for each query the ``top`` documents with the highest scores above
    0, equal scores by ascending id.

    A score is the sum of `term_weight` times `saturation` over the query's terms, repeats included, in whole numbers.
    Counts are those of all of ``docs``. The queries go to all tasks in rounds of a bounded size; for one round each task folds its
    documents into sketches, chunk by chunk, and keeps its best for each query; these are merged in two steps. So
    memory depends on neither the documents nor the queries, and no row is left out.

    Null and empty texts have no term: they are not found and find nothing, but rows of ``docs`` without an id are documents
    like any other, after all ids when scores are equal. Each row that repeats an id is a document of its own. Queries that repeat an id
    and a text are one; those that repeat an id alone are ranked each. Other columns are ignored. Without
    documents or queries there is no row.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    asked = queries.select(F.col(query_id).alias("item_id"), F.col(text).alias("text")).distinct()
    id_type, item_type = rows.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    asked = save_point(asked)
    size = asked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    rounds = max(1, -(-size.items // ROUND_ITEMS), -(-size.bytes // ROUND_BYTES))
    found = None
    for k in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).toArrow()
        part = _round(rows, Items(*[c.to_pylist() for c in some.columns]), top, id_type, item_type)
        found = part if found is None else found.unionByName(part)
    return found


def _round(rows: DataFrame, items: Items, top: int, id_type: DataType, item_type: DataType) -> DataFrame:
    """The ranks of one round, written, so that its queries need not stay in the tasks."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(items)
    counts = corpus_counts(rows, shared)
    known = spark.sparkContext.broadcast(counts)
    id_name, item_name = id_type.simpleString(), item_type.simpleString()
    arrow = pa.schema(_arrow_fields(spark, id_name, item_name))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (df, documents, all_terms) = shared.value, known.value
        if not all_terms or not items.number:
            return
        searcher = Searcher(items, df, documents, all_terms, top)
        for ids, texts in _texts(batches):
            searcher.add(ids, texts)
        best = [(q, items.ids[q], doc, -score) for q, found in enumerate(searcher.found) for score, _, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in best], f.type) for i, f in enumerate(arrow)], schema=arrow)

    found = rows.mapInArrow(search, f"query long, item_id {item_name}, doc_id {id_name}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("share", F.floor(F.spark_partition_id() / MERGED))
    for keys in (["query", "share"], ["query"]):
        best = Window.partitionBy(*keys).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    done = save_point(found.select("item_id", "rank", "doc_id", "score"))
    shared.destroy()
    known.destroy()
    return done


def _arrow_fields(spark, id_name: str, item_name: str) -> list[pa.Field]:
    """The types that a search's rows have in Arrow."""
    empty = spark.createDataFrame([], f"query long, item_id {item_name}, doc_id {id_name}, score long")
    return list(empty.toArrow().schema)
