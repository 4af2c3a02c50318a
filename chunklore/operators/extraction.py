"""Triples from any extractor: a function from texts to its JSON results, called in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import triples

Extractor = Callable[[list[str]], list[str | None]]


def pattern_extractor(texts: list[str]) -> list[str | None]:
    """A stand-in where no extractor is at hand: the first three words of every sentence as a triple."""
    import json

    out = []
    for text in texts:
        words = [s.split() for s in text.replace("!", ".").replace("?", ".").split(".")]
        out.append(json.dumps([{"extraction": {"arg1": {"text": w[0]}, "rel": {"text": w[1]}, "arg2s": [{"text": w[2]}]}} for w in words if len(w) >= 3]))
    return out


def enriched(chunks: DataFrame, extractor: Extractor, text: str = "chunk_text", as_json: bool = False, stripped: bool = False) -> DataFrame:
    """All columns, the triples (raw_oie_data as text in parentheses, or raw_oie_data_json) and raw_oie_data_plus_chunk_text. Each distinct text is extracted once; null texts and texts that the
    extractor gives nothing for have no triples."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(extractor(batch.tolist()), dtype=object)

    call = F.pandas_udf(run, "string").asNondeterministic()  # so that its column isn't put in place of its uses
    keyed = chunks.withColumn("_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    found = keyed.groupBy("_key").agg(F.first(text).alias("_text")).select("_key", call(F.coalesce("_text", F.lit(""))).alias("_raw"))
    found = found.select("_key", triples.flattened(F.col("_raw")).alias("_t")).select("_key", triples.deduplicated(F.col("_t")).alias("_t"))
    rows = keyed.join(found, "_key").withColumn("_p", triples.in_parentheses(F.col("_t")))
    shown = F.to_json("_t").alias("raw_oie_data_json") if as_json else F.col("_p").alias("raw_oie_data")
    return rows.select(*chunks.columns, shown, triples.with_triples(F.col(text), F.col("_p"), stripped).alias("raw_oie_data_plus_chunk_text"))
