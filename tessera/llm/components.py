"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a task works on, about: few links in many partitions are mostly tasks and files without rows.
LINKS = 1 << 16


def _stars(arcs: DataFrame) -> DataFrame:
    """(u, v, m) for each arc: m is the smallest of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return arcs.join(least, F.col("u") == F.col("c")).drop("c")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Only minima are gathered for a node, never its neighbours, and each round writes its links to the
    checkpoint folder; the driver sees one checksum a round. Null ends and self-links are ignored.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    state, count = None, edges.count()
    while True:
        parts = max(1, -(-count // LINKS))
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        small = _stars(large).coalesce(parts)
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state, count = now, now[0]
