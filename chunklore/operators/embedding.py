"""Vectors for texts. An embedder turns distinct texts into (text key, bucket, value) rows or arrays; each text is embedded once."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

BUCKETS = 64


class Embedder(Protocol):
    def vector(self, text: Column) -> Column:
        """array<double> of a text."""


def dot_of_counts(found: Column, vector: Column) -> Column:
    """Of the counts of these buckets with a vector."""
    return F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(vector, b))


def norm_of_counts(found: Column) -> Column:
    """Length of the counts of these buckets, which are sorted: c equal ones in a row add 1 + 3 + ... + (2c - 1)."""
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("k"), F.lit(0.0).alias("s"))

    def step(acc: Column, b: Column) -> Column:
        k = F.when(acc["b"] == b, acc["k"] + 1).otherwise(1)
        return F.struct(b.alias("b"), k.alias("k"), (acc["s"] + 2 * k - 1).alias("s"))

    return F.sqrt(F.aggregate(found, start, step, lambda acc: acc["s"]))


class Hashed:
    """Counts of lower-cased words by bucket: the first 16 bits of a word's md5, modulo the number of buckets."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets

    def bucket(self, token: Column) -> Column:
        return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % self.buckets).cast("int")

    def found(self, tokens: Column) -> Column:
        """The bucket of every token, sorted."""
        return F.array_sort(F.transform(tokens, self.bucket))

    def counted(self, found: Column) -> Column:
        """array<double>: how often each bucket comes."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.buckets - 1)), lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double"))

    def vector(self, text: Column) -> Column:
        return F.transform(F.array(self.found(words(F.lower(F.coalesce(text, F.lit("")))))), self.counted)[0]


class Precomputed:
    """Vectors of a table (text, vector)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def joined(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.join(self.table.select(F.col("text").alias(text_col), F.col("vector").alias(out_col)), text_col, "left")


def embedded_once(df: DataFrame, text_col: str, embedder: Hashed, out_col: str) -> DataFrame:
    """Each distinct text is embedded once, by its md5, and joined back."""
    keyed = df.withColumn("_key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    distinct = keyed.groupBy("_key").agg(F.first(text_col).alias("_text"))
    counts = sparse(distinct, ["_key"], "_text", embedder).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("_counts"))  # no more than there are buckets
    vector = F.transform(F.sequence(F.lit(0), F.lit(embedder.buckets - 1)), lambda i: F.coalesce(F.element_at("_counts", i), F.lit(0.0)))
    empty = F.array_repeat(F.lit(0.0), embedder.buckets)
    return keyed.join(counts, "_key", "left").withColumn(out_col, F.when(F.col("_counts").isNull(), empty).otherwise(vector)).drop("_key", "_counts")


def sparse(df: DataFrame, keys: list[str], text_col: str, embedder: Hashed) -> DataFrame:
    """keys, bucket, value for the non-zero buckets of every text."""
    token = F.explode(words(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    return df.select(*keys, token.alias("token")).groupBy(*keys, embedder.bucket(F.col("token")).alias("bucket")).agg(F.count("*").cast("double").alias("value"))
