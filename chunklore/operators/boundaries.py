"""Boundaries that two methods propose, put together, and sentence similarities as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def voted(a: Column, b: Column, threshold: float = 0.75) -> Column:
    """Boundaries whose votes, a half from each method, reach the threshold."""
    vote = lambda x: F.when(F.array_contains(a, x), 0.5).otherwise(0.0) + F.when(F.array_contains(b, x), 0.5).otherwise(0.0)
    return F.filter(merged(a, b), lambda x: vote(x) >= threshold)


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def near_both(a: Column, b: Column, tolerance: int) -> Column:
    """Those of a that b has within the tolerance."""
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance))))


def adjacent(vectors: DataFrame, doc: str, place: str, vector: str) -> DataFrame:
    """doc, place, and similarity of each unit vector to the next one."""
    follow = F.lead(vector).over(Window.partitionBy(doc).orderBy(place))
    return vectors.select(doc, place, F.col(vector).alias("a"), follow.alias("b")).filter("b IS NOT NULL").select(doc, place, dot(F.col("a"), F.col("b")).alias("similarity"))


def group_similarity(vectors: DataFrame, doc: str, place: str, group: str, vector: str) -> DataFrame:
    """Mean, min, max and population deviation of neighbours' similarities within each group."""
    follow = F.lead(vector).over(Window.partitionBy(doc, group).orderBy(place))
    rows = vectors.select(doc, group, dot(F.col(vector), F.coalesce(follow, F.array().cast("array<double>"))).alias("s"), follow.isNotNull().alias("there"))
    s = F.when(F.col("there"), F.col("s"))
    shown = lambda x: F.round(x, 4)
    return rows.groupBy(doc, group).agg(F.count("*").alias("n"), shown(F.avg(s)).alias("sim_mean"), shown(F.min(s)).alias("sim_min"), shown(F.max(s)).alias("sim_max"), shown(F.stddev_pop(s)).alias("sim_std"))


def similarity_distribution(vectors: DataFrame, doc: str, place: str, vector: str) -> DataFrame:
    """Of all pairs within a document (those not all but equal): min, max, mean, deviation, p10 to p95. A document's pairs are its own; a very long one should be cut first."""
    a = vectors.select(doc, F.col(place).alias("i"), F.col(vector).alias("a"))
    b = vectors.select(doc, F.col(place).alias("j"), F.col(vector).alias("b"))
    pairs = a.join(b, doc).filter("i < j").select(doc, dot(F.col("a"), F.col("b")).alias("s")).filter(F.col("s") < 1 - 1e-5)
    p = F.percentile("s", F.array(*[F.lit(x / 100) for x in (10, 25, 50, 75, 90, 95)]))
    out = pairs.groupBy(doc).agg(F.count("*").alias("n"), F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), p.alias("p"))
    return out.select(doc, "n", "min", "max", "mean", "std", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((10, 25, 50, 75, 90, 95))])
