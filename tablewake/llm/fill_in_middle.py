"""Fill-in-the-middle transformation as a pipeline of Arrow kernels (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "7"
#: Of a hundred texts, how many are transformed, and of these how many begin with their suffix.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts that are worked on at a time, unless one text is longer.
STEP_BYTES = 16_000_000
PLAIN, PSM, SPM = "plain", "psm", "spm"
NOTHING, LINE_FEED = (pa.scalar(s, pa.large_string()) for s in ("", "\n"))
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits that depend on the id and the seed alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(text: pa.Array, h: list[np.ndarray], rate: int, suffix_first: int) -> list[pa.Array]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of texts without nulls."""
    text = text.cast(pa.large_string())
    pieces = pc.split_pattern(text, "\n")
    counts = pc.list_value_length(pieces).to_numpy()
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    ordinal = np.arange(len(flat)) - (np.cumsum(counts) - counts)[parent]
    # Every piece but a text's last had a line feed behind it; an empty last one is no unit.
    last = ordinal == counts[parent] - 1
    unit = ~last | (pc.binary_length(flat).to_numpy() > 0)
    units = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), NOTHING, LINE_FEED), NOTHING).filter(pa.array(unit))
    parent, ordinal = parent[unit], ordinal[unit]
    n = np.bincount(parent, minlength=len(text))
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)

    low, high = cuts[0][parent], cuts[1][parent]
    roles = (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high)
    sizes = (cuts[0], cuts[1] - cuts[0], n - cuts[1])
    prefix, middle, suffix = (_rebuilt(units.filter(pa.array(role)), size) for role, size in zip(roles, sizes))

    marked = [pc.match_substring(text, mark).to_numpy(zero_copy_only=False) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = pa.array((n == 0) | np.any(marked, axis=0) | (h[2] % 100 >= rate))
    spm = pa.array(h[3] % 100 < suffix_first)
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE)}
    psm_text = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, NOTHING)
    spm_text = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, NOTHING)
    none = pa.scalar(None, pa.int64())
    return [
        pa.array(n, pa.int64()),
        pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM)),
        pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)).cast(pa.string()),
    ]


def _rebuilt(units: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Units in lists of the given sizes, each joined to one text."""
    edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(edges, units), NOTHING)


def _steps(text: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices with a bounded number of bytes."""
    ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
        yield at, upto - at
        at = upto


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output`` text.

    A text's lines, each with its line feed, are cut at two drawn places into prefix, middle and suffix, any of which may be
    empty, and joined with marks: prefix first (``psm``) or suffix first (``spm``). Empty and null texts, those that
    hold a mark, and those beyond ``rate`` stay as they are (``plain``). All draws depend on seed and id alone, so rows that repeat
    an id are cut by the same numbers, and a lost task gives the same rows again. Nothing is shuffled; a batch's lines are worked
    on in whole arrays, some bytes at a time, a long text alone. Other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))])
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in _steps(batch.column(1)):
                part = batch.slice(start, count)
                made = transform(part.column(1), [part.column(2 + k).to_numpy() for k in range(4)], rate, suffix_first)
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with a mark in it is plain, so marks part an output without doubt."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == PSM, F.concat(part(1), part(3), part(2)))
        .when(form == SPM, F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
