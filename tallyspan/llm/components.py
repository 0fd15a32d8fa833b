"""Connected components by alternating large-star and small-star steps.

Every round moves each edge a bounded number of times and writes the new edges
to the shared folder, so lineage stays short and a lost executor costs one
round at most.  Minima are combined before the shuffle; no neighbour list is ever
gathered, so a node with very many neighbours is only a large join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    if not large:
        both = both.where("v < u")
    low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    out = both.join(low, both.u == low.w)
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    every = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return every.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node reachable."""
    now = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    while True:
        now = materialize(_star(_star(now, True), False), "edges")
        # A star forest is the fixed point: its edge set no longer changes.
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == sign or got[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        sign = got
