"""Judgements, topics and documents put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_INFORMATION, integrate_document_clean, integrate_query_clean


def joined(qrels: DataFrame, topics: DataFrame, documents: DataFrame, min_query: int = 1, min_document: int = 1) -> DataFrame:
    """qrels (line, query_id, document_id, label) with query_text, document, content (the document's md5) and drop_reason: the first of no_topic, short_query, no_document, no_information,
    short_document that holds, else null. Every document is cleaned and digested once, before it meets its judgements. The planner broadcasts a side only if its size allows."""
    t = topics.select("query_id", integrate_query_clean(F.col("query_text")).alias("query_text"))
    d = documents.select("document_id", integrate_document_clean(F.col("document")).alias("document"))
    d = d.select("*", F.md5("document").alias("content"), F.length("document").alias("size"), (F.col("document") == NO_INFORMATION).alias("says_nothing"))
    rows = qrels.join(t, "query_id", "left").join(d, "document_id", "left")
    reason = (
        F.when(F.col("query_text").isNull(), "no_topic")
        .when(F.length("query_text") < min_query, "short_query")
        .when(F.col("content").isNull(), "no_document")
        .when(F.col("says_nothing"), "no_information")
        .when(F.col("size") < min_document, "short_document")
    )
    return rows.withColumn("drop_reason", reason).drop("size", "says_nothing")


def judged(rows: DataFrame) -> DataFrame:
    """drop_reason also for duplicate_pair and duplicate_content: of a query's rows with one content the first by line stays; its pair's later rows repeat a pair that was
    kept, all others repeat its content only."""
    fine = rows.filter("drop_reason IS NULL").groupBy(F.col("query_id").alias("of_query"), F.col("content").alias("of_content"))
    kept = fine.agg(F.min("line").alias("first_line"), F.min_by("document_id", "line").alias("first_document"))
    rows = rows.join(kept, (F.col("query_id") == F.col("of_query")) & (F.col("content") == F.col("of_content")) & F.col("drop_reason").isNull(), "left")
    repeated = F.when(F.col("line") > F.col("first_line"), F.when(F.col("document_id") == F.col("first_document"), "duplicate_pair").otherwise("duplicate_content"))
    return rows.withColumn("drop_reason", F.coalesce("drop_reason", repeated)).drop("of_query", "of_content", "first_line", "first_document", "content")


def integrated(qrels: DataFrame, topics: DataFrame, documents: DataFrame, min_query: int = 1, min_document: int = 1) -> DataFrame:
    """query_id, query_text, document_id, document, label of what is kept."""
    return judged(joined(qrels, topics, documents, min_query, min_document)).filter("drop_reason IS NULL").select("query_id", "query_text", "document_id", "document", "label")


def drop_counts(rows: DataFrame) -> DataFrame:
    """Rows by drop_reason; those kept as ``kept``."""
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def mapped(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """query_id replaced by its text; pairs of unknown queries are left out (see unmapped)."""
    return pairs.join(topics, "query_id").select("query_text", "chunk_text", "label")


def unmapped(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """Pairs by unknown query."""
    return pairs.join(topics, "query_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("n_skipped"))
