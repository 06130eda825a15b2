"""Sum-of-squares packing of whole documents into as few token windows as possible (operator 13)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewake.llm.bpe import IdEncoder, encoder
from tablewake.session import counted_save_point, gathered

WINDOW = 2048
END_ID = 0
#: Pieces that are packed together, in one task.
RUN_PIECES = 32_768
PIECES = "piece int, start long, length long, ids_crc32 long"


def place(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window (from 0) and the offset in it of each piece; sizes must fall.

    ``open_at[g]`` counts the open windows with a gap of g tokens. A piece goes into the gap after which the sum of the
    squared counts is least, of equals into the smallest; a new window is opened only if no gap holds it.
    """
    open_at = np.zeros(window + 1, np.int64)
    windows: list[list[int]] = [[] for _ in range(window + 1)]
    of, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        before, after = open_at[size:window], open_at[: window - size]
        gap = window
        if len(before):
            # Change of the sum if one window's gap shrinks by the piece; a full window is counted no more.
            change = 2 * (after - before) + 2
            change[0] = 1 - 2 * before[0]
            change[before == 0] = never
            best = int(np.argmin(change))
            if change[best] < never:
                gap = size + best
        if gap < window:
            w = windows[gap].pop()
            open_at[gap] -= 1
        else:
            w, made = made, made + 1
        of[i], offset[i] = w, window - gap
        if gap > size:
            windows[gap - size].append(w)
            open_at[gap - size] += 1
    return of, offset


def cut(tokens: int, window: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of a window's length but the first, which has the rest."""
    rest = tokens % window
    edges = ([0] if rest else []) + list(range(rest, tokens + 1, window))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def token_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, added: Mapping[str, int], window: int = WINDOW, end_id: int = END_ID, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``: the documents' ids, cut where one is longer than a window."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    added = tuple(added.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(IdEncoder, ranks_path, pattern, added), np.array([end_id], "<u4")
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([bpe.encode(text.as_py()), end])
                for k, (start, length) in enumerate(cut(len(ids), window)):
                    row.append(i)
                    found.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int32()] + [pa.int64()] * 3
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays], names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, {PIECES}")


def pack_whole(
    docs: DataFrame, ranks_path: str, pattern: str, added: Mapping[str, int], window: int = WINDOW, end_id: int = END_ID,
    run_pieces: int = RUN_PIECES, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text and ``end_id``; null and empty texts are ``end_id`` alone. Only a document longer than a
    window is cut, into whole windows behind a first piece with the rest. Placing needs the pieces' lengths only, so
    pieces, without their ids, are written to the shared folder first and read back in as few tasks as their number fills. A task packs
    runs of up to ``run_pieces`` by falling length; a run leaves a window or so more than its tokens fill. Windows are numbered
    from the task's number times 2**32. Repeated rows and null ids are packed like any other; other columns are ignored; an
    empty table gives no row.
    """
    pieces, count = counted_save_point(token_pieces(docs, ranks_path, pattern, added, window, end_id, id, text))
    pieces = gathered(pieces, count["rows"], run_pieces)
    pieces = pieces.withColumn("first", F.spark_partition_id().cast("long") * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for some in _runs(batches, run_pieces):
            lengths = some.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            of, offset = place(lengths[order], window)
            first = some.column("first")[0].as_py() + done
            done += int(of.max()) + 1
            out = some.drop_columns(["first"]).take(pa.array(order))
            out = out.append_column("sequence_id", pa.array(first + of)).append_column("offset", pa.array(offset))
            yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "first")
    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, `offset` long")


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of some batches in tables of ``rows`` each, the last of what is left."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
