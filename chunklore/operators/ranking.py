"""Chunks ranked within their query: BM25, cosine, reciprocal rank fusion, and labels from the scores.

All queries are ranked in one plan. Chunks are addressed by ``keys`` (query_id first); a query's corpus is its own chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import norm
from .embedding import Hashed, dot_of_counts, norm_of_counts

K1, B, EPSILON, RRF_K, PLACES = 1.5, 0.75, 0.25, 60, 9
KEYS = ["query_id", "document_id", "chunk_index"]


def _tokens(text: str) -> Column:
    return words(F.lower(F.coalesce(F.col(text), F.lit(""))))


def scored(chunks: DataFrame, queries: DataFrame, keys: list[str] = KEYS, text: str = "chunk_text", embedder: Hashed | None = None, lexical: bool = True, dense: bool = True) -> DataFrame:
    """keys, and of every chunk bm25_score (lexical: Okapi's with a floor for common terms, 0 at least) and cosine_score (dense) against its query. queries: query_id, query_text (one each).

    A query's weights and vector come to its chunks as one row, and a chunk is scored where its tokens are: what is shuffled by token are the counts of chunks that have it, alone.
    """
    embedder = embedder or Hashed()
    rows = chunks.select(*keys, _tokens(text).alias("tokens"))
    side = queries.select("query_id", _tokens("query_text").alias("asked"))
    if lexical:
        side = _weighted(rows, side)
    if dense:
        side = side.withColumn("q", embedder.counted(embedder.found(F.col("asked"))))
    rows, scores = rows.join(side.drop("asked"), "query_id", "left"), []
    if lexical:
        matched = F.filter("tokens", lambda t: F.array_contains("wanted", t))
        saturated = lambda f: f * (K1 + 1) / (f + K1 * (1 - B + B * F.size("tokens") / F.col("avgdl")))
        total = lambda m: F.aggregate("terms", F.lit(0.0), lambda s, e: s + e["weight"] * saturated(F.size(F.filter(m, lambda t: t == e["token"]))))
        score = F.transform(F.array(matched), total)[0]
        scores.append(F.round(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), PLACES).alias("bm25_score"))
    if dense:
        score = F.transform(F.array(embedder.found(F.col("tokens"))), lambda f: F.try_divide(dot_of_counts(f, F.col("q")), norm_of_counts(f) * norm(F.col("q"))))[0]
        scores.append(F.round(F.coalesce(score, F.lit(0.0)), PLACES).alias("cosine_score"))
    return rows.select(*keys, *scores)


def _weighted(rows: DataFrame, side: DataFrame) -> DataFrame:
    """side (query_id, asked) with avgdl and terms: weights of those of its distinct tokens that its chunks have."""
    # a chunk's distinct tokens, and one null with its length: one pass counts terms, chunks and lengths
    term = F.explode(F.concat(F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("dl"))), F.array(F.struct(F.lit(None).cast("string").alias("token"), F.size("tokens").alias("dl")))))
    counts = rows.select("query_id", term.alias("e")).groupBy("query_id", "e.token").agg(F.count("*").alias("df"), F.sum("e.dl").alias("dl"))
    whole = lambda c: F.max(F.when(F.col("token").isNull(), F.col(c)))
    # no filter by token: it would go down to the chunks, and they would be made twice
    corpus = counts.groupBy("query_id").agg(whole("df").alias("n"), (whole("dl") / whole("df")).alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.join(corpus, "query_id").withColumn("raw", F.when(F.col("token").isNotNull(), idf))
    # of all tokens only the mean is needed beyond the query's own
    raw = raw.join(side.select("query_id", F.col("asked").alias("own")), "query_id")
    f = F.size(F.filter("own", lambda t: t == F.col("token")))
    of = raw.groupBy("query_id").agg((EPSILON * F.avg("raw")).alias("floor"), F.first("avgdl").alias("avgdl"), F.collect_list(F.when(f > 0, F.struct("token", "raw", f.alias("qf")))).alias("own_terms"))
    weight = lambda e: F.struct(e["token"].alias("token"), (F.when(e["raw"] < 0, F.col("floor")).otherwise(e["raw"]) * e["qf"]).alias("weight"))
    terms = of.select("query_id", "avgdl", F.transform("own_terms", weight).alias("terms"), F.transform("own_terms", lambda e: e["token"]).alias("wanted"))
    return side.join(terms, "query_id", "left")


def bm25(chunks: DataFrame, queries: DataFrame, keys: list[str] = KEYS, text: str = "chunk_text") -> DataFrame:
    """keys and bm25_score."""
    return scored(chunks, queries, keys, text, dense=False)


def cosine(chunks: DataFrame, queries: DataFrame, keys: list[str] = KEYS, text: str = "chunk_text", embedder: Hashed | None = None) -> DataFrame:
    """keys and cosine_score of the query's and the chunk's vectors: no shuffle of chunks by token."""
    return scored(chunks, queries, keys, text, embedder, lexical=False)


def ranked(scores: DataFrame, score: str, out: str, keys: list[str] = KEYS) -> DataFrame:
    """1 to n by falling score within the query; ties by the other keys."""
    return scores.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), *keys[1:])))


def fused(chunks: DataFrame, queries: DataFrame, keys: list[str] = KEYS, text: str = "chunk_text", k: int = RRF_K, embedder: Hashed | None = None) -> DataFrame:
    """keys, both scores and rrf_score: 1 / (k + rank) of the one and the other."""
    both = scored(chunks, queries, keys, text, embedder)
    both = ranked(ranked(both, "bm25_score", "r1", keys), "cosine_score", "r2", keys)
    return both.select(*keys, "bm25_score", "cosine_score", F.round(1 / (k + F.col("r1")) + 1 / (k + F.col("r2")), PLACES).alias("rrf_score"))


def fused_lists(a: DataFrame, b: DataFrame, a_score: str, b_score: str, id_col: str, group: str = "query_id", k: int = RRF_K) -> DataFrame:
    """Two ranked lists that needn't have the same ids: one that a list lacks has rank max(n1, n2) + k there."""
    keys = [group, id_col]
    n = lambda d, out: d.withColumn(out, F.count("*").over(Window.partitionBy(group)))
    left = n(ranked(a.select(*keys, a_score), a_score, "r1", keys), "n1")
    right = n(ranked(b.select(*keys, b_score), b_score, "r2", keys), "n2")
    rows = left.join(right, keys, "full")
    most = lambda c: F.max(c).over(Window.partitionBy(group))
    missing = F.greatest(F.coalesce(most("n1"), F.lit(0)), F.coalesce(most("n2"), F.lit(0))) + k
    rows = rows.withColumn("missing", missing)
    score = 1 / (k + F.coalesce("r1", "missing")) + 1 / (k + F.coalesce("r2", "missing"))
    return rows.select(*keys, a_score, b_score, F.round(score, PLACES).alias("rrf_score"))


def percentile_labelled(scored: DataFrame, score: str = "rrf_score", upper: float = 0.8, lower: float = 0.2, min_group: int = 2) -> DataFrame:
    """Rows at or beyond their query's upper and lower percentile, label 1 for the upper ones; queries of fewer than ``min_group`` rows are left out."""
    cuts = scored.groupBy("query_id").agg(F.count("*").alias("n"), F.percentile(score, F.array(F.lit(upper), F.lit(lower))).alias("p")).filter(F.col("n") >= min_group)
    cuts = cuts.select("query_id", F.round(F.col("p")[0], 12).alias("hi"), F.round(F.col("p")[1], 12).alias("lo"))
    rows = scored.join(cuts, "query_id").filter((F.col(score) >= F.col("hi")) | (F.col(score) <= F.col("lo")))
    return rows.withColumn("label", (F.col(score) >= F.col("hi")).cast("int")).drop("hi", "lo")


def threshold_labelled(scored: DataFrame, score: str = "cosine_score", positive: float = 0.6, negative: float = 0.4) -> DataFrame:
    """Label 1 at ``positive`` or more, 0 at ``negative`` or less; what lies between is left out."""
    rows = scored.filter((F.col(score) >= positive) | (F.col(score) <= negative))
    return rows.withColumn("label", (F.col(score) >= positive).cast("int"))


def with_query_text(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_text joined where the column is absent; unknown queries get an empty one."""
    if "query_text" in chunks.columns:
        return chunks
    return chunks.join(queries.select("query_id", "query_text"), "query_id", "left").withColumn("query_text", F.coalesce("query_text", F.lit("")))
