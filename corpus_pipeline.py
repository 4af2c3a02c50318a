"""The corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``: whatever columns docs has, by whatever names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklore.llm import decontaminate, langid, linededup, packing, similar
from chunklore.llm.common import drop, named, unused, written

#: Mean probability that the predicted language must reach; prose reaches 0.9, and chance has a quarter with four languages.
LEAST_LANGUAGE_SCORE = 0.5


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("row"))


def _unwrapped(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return docs.select(*[F.col("text") if c == "text" else new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, no letters) go, and those with none that stands out.

    Repeated rows are judged alike; null ids and labels don't matter; an empty table gives no rows.
    """
    predict = langid.language_predictor(docs)
    own = [named(c) for c in docs.columns]
    judged = docs.select(F.struct(*own).alias("row"), predict(named("text").cast("string")).alias("judged"))
    known = (F.col("judged.lang_pred") != langid.UNDETERMINED) & (F.col("judged.score") >= LEAST_LANGUAGE_SCORE)
    return judged.filter(known).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks leave the texts; documents of which no word is left go (null and empty texts too). n_chars follows the text.

    Repeated rows share their decisions; an empty table gives no rows.
    """
    out = linededup.without_repeated_chunks(_wrapped(docs)).filter(F.col("text").rlike(r"\S"))
    return _unwrapped(out, docs.columns, n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) one row stays, that with the smallest doc_id; a null doc_id stays only where there is no other.

    Repeated rows are copies; rows of one doc_id with different texts are documents of their own; texts without words are one group; an empty table gives no rows.
    """
    return _unwrapped(similar.similar_groups(_wrapped(docs)).filter("stays"), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's passage go; null and empty texts stay. Repeated rows are judged alike; an empty table gives no rows."""
    hits = unused("hits", docs.columns)
    found = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=hits)
    return found.filter(F.size(named(hits)) == 0).select(*[named(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence; a null or empty text is one piece. Repeated rows are packed each; an empty table gives no rows."""
    pieces = packing.tokenized_pieces(docs)
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_copies), ("decontamination", benchmark), ("packing", pack)]

#: Networks, 64-bit hashes and tokenizers aren't SQL's; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
