"""Connected components of links between long ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewake.session import counted_save_point

#: Links in a partition.
ROWS = 250_000


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for each node of ``links`` (``a``, ``b``).

    Large-star and small-star rounds (Kiveris et al. 2014): every node is tied to the smallest
    neighbour it knows until all components are stars. Links stay a table throughout; each round's
    links are written to the shared folder, and only their number and a checksum come to the driver.
    Loops and repeated links do no harm; no links give no rows.
    """
    edges, counts = _saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = _checksum(edges)
    while counts:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        own, other = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(lower, "u").select(F.inline(F.array(own, other))).where("u <> v")
        edges, counts = _saved(small)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    rooted = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return edges.select(F.inline(rooted)).distinct()


def _saved(edges: DataFrame) -> tuple[DataFrame, int]:
    """Distinct links, written, and their number; as few partitions as they fill, so few links cause no shuffles."""
    edges, counts = counted_save_point(edges.distinct())
    return edges.coalesce(1 + counts["rows"] // ROWS), counts["rows"]


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
