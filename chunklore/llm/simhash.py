"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius have a variant in common, and any two that
have one are within the radius; so linking each to the smallest at its variant loses no link between components. Links are verified
by their differing bits and closed into components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, with_text, written
from .components import connected_components

BITS = 64


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is 1 if over half of the shingles' XXH64 have it; 0 without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z alone, and the six ASCII blanks
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        set_ += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long)."""
    importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def near_pairs(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """distinct: fp, each once. Verified links (a, b), a > b: each fingerprint with the smallest one at each of its variants."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: both sides emit what is within half of it")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(BITS), n)]
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    variants = distinct.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    # distinct fingerprints at one variant: no more than there are masks
    smallest = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.select("fp", smallest.alias("b")).filter("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of ``radius`` differing bits or fewer.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Rows of one fingerprint are one node whatever their
    number. Null ids stay null and are no component's id unless it has no other; repeated rows each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    closed = connected_components(near_pairs(nodes.select("fp"), radius))
    labelled = nodes.join(closed.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    labelled = written(labelled, "fingerprint-labels")
    ids = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(labelled.join(ids, "component").select("fp", "component_id"), "fingerprint-components")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
