"""Connected components of an undirected graph by alternating large and small stars (Kiveris et al., 2014).

Each round is two aggregations with map-side combine and two joins, on edges only; AQE splits the joins' hot hubs. Every round is
written to the shared folder, so lineage stays short and lost executors cost one round at most. The number of rounds grows with
the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of an edge (columns a, b: long) and the smallest node that it can reach. Self-links and repeated
    edges don't matter; nulls are no nodes; no edges: no rows."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1000003)).first())
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("w"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("w", "m")).distinct()
        old, now = now, written(small, "stars")
        dropped(old)
