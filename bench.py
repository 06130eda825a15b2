"""Seconds per headline query: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks.registry import QUERIES
from tablewake.session import local_session

HEADLINES = (
    "split_lines",
    "strip_comment_lines",
    "sessionise_log",
    "assemble_log_sql",
    "log_lineage",
    "assemble_queries",
    "split_statement_lines",
    "statement_index",
    "clean_statements",
    "table_refs",
    "lineage_edges_raw",
    "run_statistics",
    "script_lineage",
    "typed_edges",
    "volatile_map",
    "resolve_volatile",
    "end_to_end_lineage",
    "hierarchy_paths",
    "flatten_hierarchy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus)
    # Warm the JVM up on the smallest tables, if they are there.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.path.isdir(small)
    for name in names if warm else ():
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "warmed_up": warm,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
