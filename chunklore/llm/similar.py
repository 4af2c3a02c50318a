"""Near copies by shingle similarity: SimHash balls as candidates, the exact Jaccard similarity as the judge.

A similarity of 0.8 is about ten of a SimHash's 64 bits: one ball around the whole fingerprint would have millions of variants. So
the fingerprint's eight bytes have a ball each: every byte emits its variants within one bit, beside two anchors (the smallest of the text's shingles under two
hashes of the byte's own), without which eight bits would meet everywhere. A pair of similarity 0.8 shares both anchors with probability 0.64 and
then differs in at most two of the eight bits with 0.89: of eight bytes one or more meet with probability 0.999 (0.9999 at 0.85).

First everything is held against the smallest of its bucket; then all pairs of a bucket that are not in one component yet, by their shingles' 32-bit hashes within the join itself: only
pairs that pass come out of it, and their texts decide. So every colliding pair is verified or connected already, and no group of copies is squared into rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, importable, named, unused, written
from .components import connected_components
from .wordhash import UNBLANK, mixed, shingles, words

#: Bytes of a fingerprint; anchors of each. Differing bits beyond which a pair of 0.8 does not lie but once in 10^5 (ten are usual, the deviation is three).
BYTES, ANCHORS, MOST_BITS = 8, 2, 23
#: Shingles hashed at a time, so that a very long text needs no more memory.
STEP = 1 << 12
_random = np.random.default_rng(10)
_FACTOR = _random.integers(1, 1 << 63, (BYTES * ANCHORS, 1), dtype=np.uint64) | np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, (BYTES * ANCHORS, 1), dtype=np.uint64)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z alone, and the six ASCII blanks


def shingle_set(text: str, n: int = 5) -> set[tuple[bytes, ...]]:
    """Distinct runs of n words; the whole of a text with fewer words; none without words."""
    found = split_words(text)
    return set(zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else {tuple(found)} if found else set()


def jaccard(a: set, b: set) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def sketch(text: str, n: int = 5) -> tuple[int, list[int]]:
    """SimHash of the distinct shingles as a signed long, and for each of its bytes the anchors as one; no anchors without words."""
    _, _, h = words(text.encode("utf-8", "surrogatepass").lower(), UNBLANK)
    s = np.unique(shingles(h, min(n, max(1, len(h)))))
    if not len(s):
        return 0, []
    least, ones = np.full(BYTES * ANCHORS, ~np.uint64(0)), np.zeros(64, np.int64)
    for at in range(0, len(s), STEP):
        part = s[at : at + STEP]
        np.minimum(least, (part[None] * _FACTOR + _SHIFT).min(1), out=least)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    anchor = np.zeros(BYTES, np.uint64)
    for column in least.reshape(BYTES, ANCHORS).T:
        anchor = mixed(anchor ^ column)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0]), anchor.view(np.int64).tolist()


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """The distinct shingles by 32 bits of their hashes."""
    _, _, h = words(text.encode("utf-8", "surrogatepass").lower(), UNBLANK)
    return np.unique((shingles(h, min(n, max(1, len(h)))) >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def balls(nodes: DataFrame) -> DataFrame:
    """nodes: node, print, anchors. (node, bucket, spot): each byte's variants within one bit, beside its anchors; spot is the byte's place and the variant."""
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(8)))])

    def of(place):
        def one(m):
            variant = _byte("print", place).bitwiseXOR(m)
            return F.struct(F.xxhash64(F.lit(place), F.get("anchors", F.lit(place)), variant).alias("bucket"), (256 * place + variant).cast("int").alias("spot"))

        return F.transform(masks, one)

    return nodes.filter(F.size("anchors") > 0).select("node", F.explode(F.flatten(F.array(*[of(i) for i in range(BYTES)]))).alias("b")).select("node", "b.*")


def _byte(print_: str, place: int) -> Column:
    return F.expr(f"shiftrightunsigned({print_}, {8 * place}) & 255L")


def first_meeting() -> Column:
    """Of all buckets that nodes a and b meet in only one: of their first byte that does, that of the smallest variant they have in common."""
    place = F.expr("spot div 256").cast("int")
    x, differ = F.expr("shiftrightunsigned(print_a, cast(8 * (spot div 256) as int)) & 255L"), F.expr("shiftrightunsigned(print_a ^ print_b, cast(8 * (spot div 256) as int)) & 255L")
    low = differ.bitwiseAND(-differ)
    # of one or two differing bits each, flipped, gives a common variant; of none the byte itself does
    smallest = F.when(F.bit_count(differ) == 1, F.least(x, x.bitwiseXOR(differ))).otherwise(F.least(x.bitwiseXOR(low), x.bitwiseXOR(differ).bitwiseXOR(low)))
    # a function of an array, not eight terms in a row: Java compiles no method as long as those made the join's
    before = F.exists(F.slice(F.array(*[F.lit(j) for j in range(BYTES - 1)]), F.lit(1), place), lambda j: (F.get("anchors_a", j) == F.get("anchors_b", j)) & (F.bit_count(F.call_function("shiftrightunsigned", F.col("print_a").bitwiseXOR(F.col("print_b")), 8 * j).bitwiseAND(F.lit(255))) <= 2))
    return (F.expr("spot % 256") == smallest) & ~before


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Of pairs (a, b) those whose texts have the similarity. texts: node, print, text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some, sets = batch.slice(at, 64).to_pydict(), {}
                for node, text in (*zip(some["a"], some["text_a"], strict=True), *zip(some["b"], some["text_b"], strict=True)):
                    if node not in sets:
                        sets[node] = shingle_set(text, n)
                met = [(a, b) for a, b in zip(some["a"], some["b"], strict=True) if jaccard(sets[a], sets[b]) >= threshold]
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in met], pa.int64()), "b": pa.array([b for _, b in met], pa.int64())})

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, component_id (the smallest id reachable over pairs of texts whose n-word shingles have the Jaccard similarity ``threshold`` or more) and
    ``stays``: true for one row of each component, that with the smallest id (null last; of equal ids any one).

    Texts of the same words are one node (by 64 bits of their words' hash); all texts without words are one. A component of null ids alone has a null
    component_id. Repeated rows are copies of each other. Columns named component_id and stays are replaced, other names pass through, dots and all. An empty table
    gives no rows.
    """
    importable(docs.sparkSession)

    @F.pandas_udf("node long, print long, anchors array<long>")
    def sketched(text: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        node = pd.Series([xxh64_intdigest(b" ".join(split_words(t))) for t in text], dtype="uint64").astype("int64")
        found = [sketch(t, n) for t in text]
        return pd.DataFrame({"node": node, "print": pd.Series([p for p, _ in found], dtype="int64"), "anchors": pd.Series([a for _, a in found], dtype=object)})

    own = [c for c in docs.columns if c not in ("component_id", "stays")]
    text = unused("text", own)
    rows = docs.select(F.struct(*[named(c) for c in own]).alias("row"), named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias(text))
    rows = rows.select("row", "id", F.col(text).alias("body"), sketched(F.col(text)).alias("s")).select("row", "id", "s.*", F.xxhash64("body").alias("mark"), F.monotonically_increasing_id().alias("key"))
    keyed = written(rows, "sketched-documents")
    body = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    one = keyed.groupBy("node").agg(F.min(order).alias("first"), F.first("print").alias("print"), F.first("anchors").alias("anchors"), F.min("mark").alias("mark"))
    nodes = written(one, "word-nodes")
    banded = written(balls(nodes), "balls")
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").drop("n"), "buckets")
    met = written(banded.join(shared, "bucket").join(nodes.select("node", "print"), "node"), "met")
    drop(banded)
    # a node's text, of those that meet another: one of its rows'
    some = nodes.join(met.select("node").distinct(), "node", "left_semi")
    texts = keyed.join(some.select("node", F.col("mark").alias("of")), "node").filter("mark = of").select("node", body.alias("text")).dropDuplicates(["node"])
    texts = written(texts, "met-texts")
    prints = nodes.select(F.col("node").alias("least"), F.col("print").alias("print_least"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MOST_BITS
    star = met.filter("node > least").select("node", "least", "print").distinct().join(prints, "least").filter(near("print", "print_least"))
    links = written(verified(star.select(F.col("node").alias("a"), F.col("least").alias("b")), texts, threshold, n), "links")
    known = connected_components(links)
    labelled = met.join(known, "node", "left").select("bucket", "spot", "least", "node", "print", F.coalesce("component", "node").alias("component"))
    labelled = written(labelled, "met-components")
    drop(met)
    apart = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    left = written(labelled.join(apart, "bucket", "left_semi"), "buckets-apart")
    # the smallest of a bucket was held against all of it
    rest = left.filter("node <> least")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_hashes(t, n) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["node", "shingles"])

    sets = written(texts.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(hashed, "node long, shingles array<int>"), "shingle-sets")
    own_ = sets.join(nodes.select("node", "anchors"), "node")
    side = lambda x: rest.join(own_, "node").select("bucket", "spot", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "print", "anchors", "shingles")])
    shared_ = F.size(F.array_intersect("shingles_a", "shingles_b")) * (1 + threshold)
    alike = shared_ >= (threshold - 0.002) * (F.size("shingles_a") + F.size("shingles_b"))  # the little for hashes that are equal by chance
    pairs = side("a").join(side("b"), ["bucket", "spot"]).filter((F.col("node_a") > F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & near("print_a", "print_b") & first_meeting() & alike)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    more = written(verified(written(pairs, "pairs-apart"), texts, threshold, n), "more-links")
    closed = connected_components(written(links.unionByName(more), "all-links"))
    labels = written(nodes.join(closed, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "node-components")
    drop(labelled, left, texts)
    firsts = labels.groupBy("component").agg(F.min("first").alias("least"))
    out = written(labels.join(firsts, "component").select("node", F.col("least.id").alias("component_id"), F.col("least.key").alias("stays")), "named-nodes")
    return keyed.join(out, "node").select(*[F.col("row").getField(c).alias(c) for c in own], "component_id", (F.col("key") == F.col("stays")).alias("stays"))
