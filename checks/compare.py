"""Run every query and its SQL side by side: ``python -m checks.compare <folder> [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from tablewake.session import local_session

from .oracles import ORACLES
from .registry import QUERIES


def duckdb_over(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows as sorted text."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    values = [tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(values, key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark, con, name: str, sf_dir: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    spent = time.time() - started
    started = time.time()
    result = con.execute(ORACLES[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    duck = time.time() - started
    if ours[0] != theirs[0]:
        return f"DIFF {name}: columns {ours[0]} / {theirs[0]}"
    verdict = "ok  " if ours[1] == theirs[1] else "DIFF"
    text = f"{verdict} {name}: {len(ours[1])} / {len(theirs[1])} rows, spark {spent:.1f} s, duckdb {duck:.1f} s"
    if verdict == "DIFF":
        left, right = set(ours[1]), set(theirs[1])
        text += f"\n   only spark {list(left - right)[:3]}\n   only duckdb {list(right - left)[:3]}"
    return text


def main() -> None:
    sf_dir = sys.argv[1]
    spark, con = local_session(8), duckdb_over(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        if name not in ORACLES:
            print(f"none {name}: no SQL", flush=True)
            continue
        try:
            print(compare(spark, con, name, sf_dir), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
