"""Chunking over a stream: cleaning and fixed-width chunks are stateless, so the batch expressions serve as they are; counts by window need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking


def documents(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """New Parquet files in a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 600, overlap: int = 0) -> DataFrame:
    """The chunks of every new document, as they are written."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chunking.written_form(chunking.chunked(rows, chunking.fixed_width(F.col("text"), F.col("doc_id"), size, overlap), "doc_id"))


def counted(chunks: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Chunks and characters by window of event time; what comes later than ``late`` is not counted."""
    by = F.window(time_col, window).alias("window")
    return chunks.withWatermark(time_col, late).groupBy(by).agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


def to_parquet(df: DataFrame, path: str, checkpoint: str):
    """Exactly once: the file sink's log and the checkpoint go together."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
