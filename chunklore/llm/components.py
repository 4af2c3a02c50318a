"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Per node of an edge: node, component (its smallest node).

    Every round each node takes its smallest neighbour for a parent, twice over, and the edges are contracted to parents; at least half of the nodes
    that still have edges go, so rounds grow with the logarithm. A node's neighbours are only ever aggregated, never
    gathered. Every round's tables are written, so a lost executor costs the round's own work at most.
    """
    left = written(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct(), "edges")
    maps = []
    while not left.isEmpty():
        parent = written(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        one, parent = parent, written(parent.join(up, "parent").select("node", F.col("grand").alias("parent")), "parents")
        maps.append(parent)
        of = lambda side: parent.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))  # noqa: B023, E731
        done, left = left, written(left.join(of("a"), "a").join(of("b"), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        drop(one, done)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    out = maps[0].withColumnRenamed("parent", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
