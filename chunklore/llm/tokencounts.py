"""Token counts through a digest cache.

Content digests are joined to counts stored for this very tokenizer file; only distinct texts that the cache lacks are encoded,
and their counts are appended to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exists, importable, tokenizer_path, with_text, written

CACHE = "digest binary, n_tokens long"


def version_of(path: str) -> str:
    """Digest of a tokenizer's file: counts of another version are never taken for this one's."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()[:32]


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    cache_path: a folder all executors see; a folder in it belongs to each tokenizer version. Content is normalised by
    taking null as empty and no further, as any other change could change the count. Null ids stay null; repeated
    rows each give a row and are encoded once; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    version = version_of(tokenizer_path(tokenizer))
    stored = f"{cache_path.rstrip('/')}/{version}"
    if not exists(spark, stored):
        spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(stored)
    texts = with_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256))).withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    # digests alone say what the cache lacks; a text is read again only where it does
    distinct = texts.groupBy("digest").agg(F.min(F.struct("no_id", "id")).alias("first")).select("digest", "first.*")
    misses = written(distinct.join(spark.read.schema(CACHE).parquet(stored), "digest", "left_anti"), "missed-digests")

    def count(batches):
        from .wordcache import encoder

        path = tokenizer_path(tokenizer)
        if version_of(path) != version:
            raise ValueError(f"{path} is another version than the driver's")
        encode = encoder(path)
        for batch in batches:
            n: list[int] = []
            for at in range(0, batch.num_rows, 64):
                n += [len(ids) // 4 for ids in encode(batch.column("text").slice(at, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    if not misses.isEmpty():
        # the document with the smallest id speaks for its digest; only its own repeated rows meet it
        speaker = ["digest", "no_id", "id"]
        found = texts.join(misses, speaker).groupBy(*speaker).agg(F.first("text").alias("text"))
        found.select("digest", "text").mapInArrow(count, CACHE).write.mode("append").parquet(stored)
    # once each, whoever else appended; written, so that the join below is of two plain tables and a hot digest's rows can be split
    counts = written(spark.read.schema(CACHE).parquet(stored).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    keys = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
