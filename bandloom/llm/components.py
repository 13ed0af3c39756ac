"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        out = linked.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, root)`` for every node of an edge; root is the least node.

    Self loops, repeated edges and nulls are ignored. Each round is written to the shared folder, and a
    checksum of the rounds tells when nothing changes any more.
    """
    now = materialize(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    told = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if tuple(sums) == told or not sums[0]:
            break
        told = tuple(sums)
        now = materialize(_star(_star(now, True), False), "stars")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
