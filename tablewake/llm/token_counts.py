"""Token counts of sections by offset-mapped attribution (operator 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewake.llm.bpe import SpanEncoder, encoder

BETWEEN = -1
SCHEMA = "section int, start long, `end` long, n_tokens long, n_crossing long, doc_tokens long"


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First characters and ends of a text's lines, without their line feeds."""
    lengths = np.array([len(line) for line in text.split("\n")], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    return starts, starts + lengths


def attribute(
    token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it reaches beyond it.

    Sections are in order and apart. A token belongs to the section that has most of its characters, of
    equals to the first; a token with no character in any belongs to none (`BETWEEN`).
    """
    # Empty sections hold no character, so they take no part.
    real = np.flatnonzero(ends > starts)
    low, high = starts[real], ends[real]
    first = np.searchsorted(high, token_starts, "right")
    last = np.searchsorted(low, token_ends, "left")
    best, most = np.full(len(token_starts), BETWEEN), np.zeros(len(token_starts), np.int64)
    for step in range(int((last - first).max(initial=0))):
        at = first + step
        there = at < last
        here = np.minimum(at, len(real) - 1)
        common = np.minimum(high[here], token_ends) - np.maximum(low[here], token_starts)
        better = there & (common > most)
        best[better], most[better] = real[here[better]], common[better]
    return best, most < token_ends - token_starts


def section_tokens(docs: DataFrame, path: str, sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = lines) -> DataFrame:
    """A row for each section of each document: ``doc_id``, ``section`` (from 0), ``start``, ``end`` (characters),
    ``n_tokens``, ``n_crossing`` (tokens among them that reach beyond the section), ``doc_tokens``.

    Each whole text is encoded once with the vocabulary file ``path``; the tokens' character spans are then
    joined to the sections' by interval. A token that crosses a boundary counts once, for the section with most
    of its characters, of equals the first; tokens outside all sections count for section -1, given where
    there are any. So the counts of a document add up to ``doc_tokens``. Null and empty texts have one empty
    section. Repeated rows and null ids are counted like any other; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        out = []
        for text, (ids, token_starts, token_ends) in zip(texts, encoder(SpanEncoder, path).encode(texts)):
            starts, ends = sections(text)
            of, crossing = attribute(token_starts, token_ends, starts, ends)
            n = np.bincount(of + 1, minlength=len(starts) + 1)
            crossed = np.bincount(of + 1, crossing, len(starts) + 1).astype(np.int64)
            names = np.arange(-1, len(starts))
            some = slice(0 if n[0] else 1, None)
            bounds = [np.concatenate([[0], starts]), np.concatenate([[0], ends])]
            out.append(tuple(x[some] for x in (names, *bounds, n, crossed, np.full(len(names), len(ids)))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = count(part.column(1).to_pylist())
                sizes = [len(f[0]) for f in found]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
                columns = [np.concatenate(c) for c in zip(*found)]
                kinds = [pa.int32()] + [pa.int64()] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
