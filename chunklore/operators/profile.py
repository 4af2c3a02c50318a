"""Profiles of documents and chunks. Percentiles are exact, with linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences_profile, word_tokens, words

#: Sentence-count buckets: name and largest count; the last has no end.
BUCKETS = [("0", 0), ("1", 1), ("2", 2), ("3", 3), ("4-5", 5), ("6-10", 10), ("11-20", 20), ("21-50", 50), ("51+", None)]


def described(df: DataFrame, column: str, percents: tuple[int, ...] = (10, 25, 75, 90), places: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """count, min, max, mean, median, percentiles and population deviation, all from one pass."""
    c = F.col(column)
    shown = (lambda x: F.round(x, places)) if places is not None else (lambda x: x)
    p = F.percentile(c, F.array(F.lit(0.5), *[F.lit(x / 100) for x in percents])).alias("_p")
    out = df.groupBy(*by).agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), shown(F.avg(c)).alias("mean"), shown(F.stddev_pop(c)).alias("std"), p)
    return out.select(*by, "count", "min", "max", "mean", F.get("_p", F.lit(0)).alias("median"), *[F.get("_p", F.lit(i + 1)).alias(f"p{x}") for i, x in enumerate(percents)], "std")


def lengths(docs: DataFrame, text: str) -> DataFrame:
    """All columns and word_count, sentence_count, avg_words_per_sentence."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"word_count": F.size(words(t)), "sentence_count": F.size(sentences_profile(t))})
    return out.withColumn("avg_words_per_sentence", F.coalesce(F.try_divide(F.col("word_count").cast("double"), F.col("sentence_count").cast("double")), F.lit(0.0)))


def overall_ratio(measured: DataFrame) -> DataFrame:
    """Words by sentences over all documents; 0 without sentences."""
    ratio = F.try_divide(F.sum("word_count").cast("double"), F.sum("sentence_count").cast("double"))
    return measured.agg(F.coalesce(ratio, F.lit(0.0)).alias("words_per_sentence"))


def distribution(measured: DataFrame, column: str = "sentence_count") -> DataFrame:
    return measured.groupBy(column).agg(F.count("*").alias("n_documents"))


def bucketed(measured: DataFrame, column: str = "sentence_count") -> DataFrame:
    """Documents by bucket, empty buckets too."""
    label: Column | None = None
    for name, most in BUCKETS:
        hit = F.col(column) <= most if most is not None else F.lit(True)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    counts = measured.groupBy(label.alias("bucket")).agg(F.count("*").alias("n_documents"))
    every = measured.sparkSession.createDataFrame([(n,) for n, _ in BUCKETS], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def chunks_per_document(chunks: DataFrame, *by: str) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"))


def duplicates(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """One row: chunks, texts that come twice or more, and the share of chunks that repeat an earlier one."""
    counts = chunks.groupBy(F.md5(text).alias("k")).agg(F.count("*").alias("n"))
    ratio = F.coalesce(F.try_divide(F.sum(F.col("n") - 1).cast("double"), F.sum("n").cast("double")), F.lit(0.0))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chunks"), F.count_if(F.col("n") > 1).alias("n_duplicated"), F.round(ratio, 4).alias("duplicate_ratio"))


def top_duplicates(chunks: DataFrame, text: str = "chunk_text", n: int = 5) -> DataFrame:
    counts = chunks.groupBy(F.col(text)).agg(F.count("*").alias("n")).filter("n > 1")
    return counts.orderBy(F.desc("n"), text).limit(n)


def token_counts(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    return chunks.select(F.explode(word_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary_stats(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """One row: distinct tokens, tokens, their ratio, tokens a chunk."""
    counts = token_counts(chunks, text).agg(F.count("*").alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"))
    n = chunks.agg(F.count("*").alias("n_chunks"))
    ratio = lambda a, b, places: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), places)
    return counts.join(n).select("n_types", "n_tokens", ratio("n_types", "n_tokens", 4).alias("type_token_ratio"), ratio("n_tokens", "n_chunks", 3).alias("tokens_per_chunk"))  # one row each


def top_tokens(chunks: DataFrame, text: str = "chunk_text", n: int = 20) -> DataFrame:
    return token_counts(chunks, text).orderBy(F.desc("n"), "token").limit(n)


def longest(chunks: DataFrame, *ids: str, text: str = "chunk_text", n: int = 10, preview: int = 130) -> DataFrame:
    """The longest chunks by words, with the start of their text on one line."""
    shown = F.substring(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), 1, preview)
    return chunks.select(*ids, F.size(words(F.col(text))).alias("n_words"), shown.alias("preview")).orderBy(F.desc("n_words"), *ids).limit(n)


def first_documents(chunks: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    """Chunks of the n keys that come first by ``order``."""
    some = chunks.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first", *keys).limit(n)
    return chunks.join(some.drop("_first"), list(keys), "left_semi")


def compared_files(chunks: DataFrame, file: str = "file", text: str = "chunk_text") -> DataFrame:
    """One row for each file, by mean words."""
    sized = chunks.withColumn("_w", F.size(words(F.col(text))))
    return sized.groupBy(file).agg(F.count("*").alias("n_chunks"), F.round(F.avg("_w"), 3).alias("mean_words"), F.max("_w").alias("max_words")).orderBy("mean_words", file)


def evaluation_summary(measured: DataFrame, per_document: DataFrame) -> DataFrame:
    """measure, count, min, max, mean, p50, p90, p95 of sentences, words, tokens and chars of chunks, and of chunks by document."""
    rows = measured.unpivot([], ["sentences", "words", "tokens", "chars"], "measure", "value").select("measure", F.col("value").cast("long").alias("value"))
    rows = rows.unionByName(per_document.select(F.lit("chunks_per_document").alias("measure"), F.col("n_chunks").alias("value")))
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return rows.groupBy("measure").agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), p.alias("p")).select("measure", "count", "min", "max", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p95"))


def label_distribution(rows: DataFrame, *ids: str) -> DataFrame:
    """Rows, and distinct ids, by label."""
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in ids])


def standardised(df: DataFrame, column: str, by: str, tau: float) -> DataFrame:
    """z and sigmoid of a column within its group."""
    w = Window.partitionBy(by)
    z = (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + 1e-9)
    return df.withColumn("z", z).withColumn("sigmoid", 1 / (1 + F.exp(-F.col("z") / tau)))
