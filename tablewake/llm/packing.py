"""Sum-of-squares online packing of documents into token windows (operator 1)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewake.llm.bpe import IdEncoder, encoder

WINDOW = 2048
END_ID = 1
#: Windows that may be partially filled at a time, in one task.
OPEN_WINDOWS = 2048
#: The share of a window from which it leaves as it was built when a task's partial windows are closed.
NEARLY_FULL = 0.95
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class Packer:
    """Sum-of-squares packing: a level array counts the partially filled windows of each fill level.

    A document goes to the level (or a new window) after which the sum of the squared counts is least; of
    equals, to the fullest. Whole windows of a long document stand alone, its rest is placed so. A
    window leaves once it is full. Beyond ``open_windows`` partial windows, and at the end, those that are nearly full
    leave as they are; the pieces of the others are laid end to end and cut at the window size: every token keeps its
    place in its document, memory stays bounded, and one window at most is padded by more than a twentieth.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.limit = window, open_windows
        self.level = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Put a piece (document, start, ids) in; gives the windows that are full by now."""
        size = len(piece[2])
        if size == self.window:
            return [[piece]]
        h = self._best(size)
        if h:
            pieces = self.at[h].pop()
            self.level[h] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            return [pieces]
        self.at[h + size].append(pieces)
        self.level[h + size] += 1
        self.open += 1
        return self.close(keep=True) if self.open > self.limit else []

    def _best(self, size: int) -> int:
        n, top = self.level, self.window - size
        # Change of the sum if a window moves from level h to h + size; a full one is counted no more.
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top]
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(change[::-1]))

    def close(self, keep: bool = False) -> list[list[tuple]]:
        """Give out the nearly full windows and lay the pieces of the others end to end; the last stays open if ``keep``."""
        nearly = math.ceil(NEARLY_FULL * self.window)
        done = [window for level in self.at[nearly:] for window in level]
        pieces = [p for level in reversed(self.at[:nearly]) for window in level for p in window]
        self.__init__(self.window, self.limit)
        now, filled = [], 0
        for doc, start, ids in pieces:
            while len(ids):
                part = ids[: self.window - filled]
                now.append((doc, start, part))
                filled += len(part)
                start, ids = start + len(part), ids[len(part) :]
                if filled == self.window:
                    done.append(now)
                    now, filled = [], 0
        if now and keep:
            self.at[filled].append(now)
            self.level[filled] += 1
            self.open = 1
        elif now:
            done.append(now)
        return done


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, window: int = WINDOW, id: str = "doc_id", text: str = "text",
    end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, added: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row for each piece of a document in a window: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text, with the vocabulary's ``added`` tokens, and ``end_id``; null and empty texts are
    ``end_id`` alone. Each input partition packs its own rows as they come, so nothing is shuffled, a lost task is redone alone, and a
    partition pads one window at most by more than a twentieth. Windows are numbered from the partition's number times 2**32.
    Repeated rows and null ids are packed like any other; other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("first", F.spark_partition_id().cast("long") * (1 << 32))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    added = tuple((added or {}).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, end = encoder(IdEncoder, ranks_path, pattern, added), Packer(window, open_windows), np.array([end_id], "<u4")
        sequence, kind = None, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            if sequence is None and batch.num_rows:
                sequence = batch.column(2)[0].as_py()
            done: list[list[tuple]] = []
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = np.concatenate([bpe.encode(text.as_py()), end])
                    for start in range(0, len(ids), window):
                        # A copy, so that an open window does not hold a long document as a whole.
                        part = ids[start : start + window].copy()
                        done += packer.place(((doc, len(ids)), start, part))
            if done:
                yield _rows(done, sequence, kind)
                sequence += len(done)
        if sequence is not None and (done := packer.close()):
            yield _rows(done, sequence, kind)

    return rows.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


def _rows(windows: list[list[tuple]], first: int, kind: pa.DataType) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(7)]
    for k, pieces in enumerate(windows):
        offset = 0
        for (doc, tokens), start, ids in pieces:
            row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, first + k, offset)
            for values, value in zip(out, row):
                values.append(value)
            offset += len(ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(out[0], kind)] + [pa.array(values, pa.int64()) for values in out[1:]]
    return pa.RecordBatch.from_arrays(arrays, names=names)
