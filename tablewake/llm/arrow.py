"""Row-wise Arrow helpers shared by the operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a batch that are worked on at a time.
ROWS = 1_000


def add_columns(
    df: DataFrame,
    inputs: list[str],
    added: list[StructField],
    work: Callable[..., list[pa.Array]],
) -> DataFrame:
    """``df`` with columns computed from ``inputs`` by ``work``, some rows at a time, in the tasks that hold the rows.

    ``work`` gets one Arrow array for each input and gives one for each added column. A column of
    ``df`` with the name of an added one is replaced.
    """
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    mark = "__in"
    while any(f.name.startswith(mark) for f in kept):
        mark += "_"
    hidden = [f"{mark}{i}" for i in range(len(inputs))]
    source = df.select(*[quoted(f.name) for f in kept], *[quoted(c).alias(h) for c, h in zip(inputs, hidden)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                n = batch.num_columns - len(hidden)
                made = work(*[batch.column(n + i) for i in range(len(hidden))])
                names_out = batch.schema.names[:n] + names
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + made, names=names_out)
        # The next task of this worker may need little.
        whole = batch = None
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, StructType(kept + added))


def quoted(name: str):
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
