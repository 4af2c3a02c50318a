"""Fixed-width chunks, and tables about chunks of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_clean, sentences_strict, token_count, words

META = "chunk_id string, sent_indices string, n int, sim_mean double, sim_min double, sim_max double, sim_std double, exemplar int, exemplar_centrality double"


def fixed_width(text: Column, doc_id: Column, size: int = 600, overlap: int = 0) -> Column:
    """array<struct<chunk_index, chunk_id, chunk_text, start, end>>; neighbours share ``overlap`` characters (at least 0, less than size). A size of 0 or less gives the whole
    text; an empty text gives nothing."""
    n = F.length(text)
    if size <= 0:
        starts = F.array(F.lit(0))
        width: Column = n
    else:
        step = size - max(0, min(overlap, size - 1))
        count = F.greatest(F.lit(1), F.ceil((n - size) / step) + 1).cast("int")
        starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
        width = F.lit(size)

    def one(start: Column, i: Column) -> Column:
        part = F.substr(text, start + 1, width)
        return F.named_struct(F.lit("chunk_index"), i, F.lit("chunk_id"), F.concat(doc_id.cast("string"), F.lit("_chunk"), i.cast("string")), F.lit("chunk_text"), part, F.lit("start"), start, F.lit("end"), start + F.length(part))

    return F.when(n > 0, F.transform(starts, one)).otherwise(F.array().cast("array<struct<chunk_index:int,chunk_id:string,chunk_text:string,start:int,end:int>>"))


def chunked(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """A row for each chunk: the kept columns and the chunk's; no shuffle."""
    return docs.select(*keep, F.explode(chunks).alias("c")).select(*keep, "c.*")


def written_form(chunks: DataFrame) -> DataFrame:
    """chunk_text as it is written; what is empty then is left out."""
    return chunks.withColumn("chunk_text", chunk_clean(F.col("chunk_text"))).filter("chunk_text <> ''")


def measured(chunks: DataFrame, *keep: str) -> DataFrame:
    """sentences, words, tokens and chars of every chunk."""
    t = F.col("chunk_text")
    return chunks.select(*keep, F.size(sentences_strict(t)).alias("sentences"), F.size(words(t)).alias("words"), token_count(t).alias("tokens"), F.length(t).alias("chars"))


def chunk_map(chunks: DataFrame, *keep: str) -> DataFrame:
    """meta_json to columns."""
    m = F.from_json("meta_json", META)
    names = {"sent_indices": "sent_indices", "n": "n_sent", "sim_mean": "sim_mean", "sim_min": "sim_min", "sim_max": "sim_max", "sim_std": "sim_std", "exemplar": "anchor", "exemplar_centrality": "anchor_centrality"}
    return chunks.select(*keep, m.alias("m")).select(*keep, F.col("m.chunk_id"), *[F.col(f"m.{a}").alias(b) for a, b in names.items()])
