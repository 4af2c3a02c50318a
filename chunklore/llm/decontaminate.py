"""Benchmark passages in documents.

Windows as long as the benchmark's items get SimHash fingerprints; a multi-index over eight 8-bit blocks returns every item of
that length within the radius (a pair within 23 bits has a block within 2), and the exact weighted similarity of five-word
shingles verifies. Windows that could not reach the similarity whatever their fingerprint are passed over without loss: one needs
2t / (1 + t) of its shingles among the benchmark's. An item of fewer words than a shingle is one shingle as a whole, and found where the same words stand.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, named, unused, written
from .wordhash import STEP, shingles, words

HITS = "array<struct<item_id:bigint,start:bigint,n_words:int,similarity:double>>"
RADIUS, BLOCKS = 23, 8
#: Windows fingerprinted at a time.
WINDOWS = 2048
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(8), n)], np.uint8)
_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


def simhashes(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """For each window of m hashes from ``at`` (ascending) eight bytes: a bit is 1 if over half of the hashes have it."""
    out = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > m) + 1):
        for some in np.split(run, range(WINDOWS, len(run), WINDOWS)):
            own = np.ascontiguousarray(hashes[some[0] : some[-1] + m])
            sums = np.zeros((len(own) + 1, 64), np.int32)
            np.cumsum(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32, out=sums[1:])
            first = some - some[0]
            out.append(np.packbits(2 * (sums[first + m] - sums[first]) > m, axis=1))
    return np.concatenate(out)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared counts over all counts."""
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


class Index:
    """Items (item_id, text) by length; for one pass over the documents."""

    def __init__(self, items: list[tuple[int, str]], n: int = 5, threshold: float = 0.8):
        self.n, self.threshold = n, threshold
        self.items: list[tuple[int, Counter]] = []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        every = [np.zeros(0, np.uint64)]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # words, hash of them all, items
        for item_id, text in items:
            data = (text or "").lower().encode("utf-8", "surrogatepass")
            start, end, h = words(data)
            s = shingles(h, n)
            if len(s):
                by_length[len(h)].append((len(self.items), simhashes(s, np.zeros(1, np.int64), len(s))[0]))
                self.items.append((item_id, self.counted(data, start, end)))
                every.append(s)
            elif len(h):
                self.short[len(h)][int(shingles(h, len(h))[0])].append(len(self.items))
                self.items.append((item_id, self.counted(data, start, end)))
        self.short_hashes = {k: np.array(sorted(of), np.uint64) for k, of in self.short.items()}
        self.every = np.unique(np.concatenate(every))
        self.shift = np.uint64(64 - max(10, min(26, math.ceil(math.log2(64 * len(self.every) + 1)))))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[(self.every >> self.shift).astype(np.int64)] = True
        self.lengths = {}
        for length, of in by_length.items():
            prints = np.array([p for _, p in of])
            tables = [np.array([(_NEAR[:, None] ^ np.uint8(v) == prints[:, b]).any(0) for v in range(256)]) for b in range(BLOCKS)]
            self.lengths[length] = np.array([i for i, _ in of]), prints, tables

    def counted(self, data: bytes, start: np.ndarray, end: np.ndarray) -> Counter:
        """Shingles and how often they come; all words as one where they are fewer."""
        found = [data[a:b] for a, b in zip(start, end, strict=True)]
        return Counter(zip(*(found[i:] for i in range(max(1, min(self.n, len(found))))), strict=False))

    def short_hits(self, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray):
        """(item, first word) of items shorter than a shingle, at the first place of their words."""
        for k, of in self.short.items():
            s = shingles(h, k)
            left = {i for same in of.values() for i in same}
            for p in np.flatnonzero(np.isin(s, self.short_hashes[k])).tolist():
                for i in [i for i in of[int(s[p])] if i in left and self.counted(data, start[p : p + k], end[p : p + k]) == self.items[i][1]]:
                    left.discard(i)
                    yield i, p, k

    def known(self, s: np.ndarray) -> np.ndarray:
        """Places of the shingles that the items have."""
        at = np.flatnonzero(self.there[(s >> self.shift).astype(np.int64)])
        return at[self.every[np.minimum(np.searchsorted(self.every, s[at]), len(self.every) - 1)] == s[at]]

    def near(self, length: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all whose fingerprints differ in RADIUS bits or fewer."""
        at, prints, tables = self.lengths[length]
        met = tables[0][windows[:, 0]]
        for b in range(1, BLOCKS):
            met |= tables[b][windows[:, b]]
        w, i = np.nonzero(met)
        close = _ONES[prints[i] ^ windows[w]].sum(1) <= RADIUS
        return w[close], at[i[close]]

    def hits(self, text: str | None) -> list[dict]:
        """The best window for each item found, by item."""
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if not self.items or not data:
            return []
        start, end, h = words(data)
        s = shingles(h, self.n)
        known = np.zeros(len(s) + 1, np.int64)
        known[self.known(s) + 1] = 1
        sums = np.cumsum(known)
        best: dict[int, tuple[float, int, int]] = {i: (1.0, -p, k) for i, p, k in self.short_hits(data, start, end, h)}
        for length in self.lengths:
            m = length - self.n + 1
            if m > len(s):
                continue
            full = np.flatnonzero(sums[m:] - sums[:-m] >= math.ceil(2 * self.threshold / (1 + self.threshold) * m - 1e-9))
            for some in np.split(full, range(WINDOWS, len(full), WINDOWS)) if len(full) else ():
                counted: dict[int, Counter] = {}
                for w, i in zip(*self.near(length, simhashes(s, some, m)), strict=True):
                    p = int(some[w])
                    counts = counted.get(p) or counted.setdefault(p, self.counted(data, start[p : p + length], end[p : p + length]))
                    score = similarity(counts, self.items[i][1])
                    if score >= self.threshold and (score, -p) > best.get(i, (0, 0, 0))[:2]:
                        best[i] = score, -p, length
        out = [{"item_id": self.items[i][0], "start": -p, "n_words": length, "similarity": score} for i, (score, p, length) in best.items()]
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"], x["start"]))


    def hits_of(self, texts: list[str | None]) -> list[list[dict]]:
        """hits() of each; texts with fewer of the benchmark's shingles than any item asks for are sorted out together."""
        out: list[list[dict]] = [[] for _ in texts]
        least = min((math.ceil(2 * self.threshold / (1 + self.threshold) * (k - self.n + 1) - 1e-9) for k in self.lengths), default=0)
        at = 0
        while self.items and at < len(texts):
            some, size, to = [], 0, at
            while to < len(texts) and (size < STEP or not some):
                some.append((texts[to] or "").lower().encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                to += 1
            start, _, h = words(b"\n".join(some))
            s = shingles(h, self.n)
            first = np.cumsum([0, *(len(x) + 1 for x in some)])
            many = np.diff(np.searchsorted(start[self.known(s)], first)) >= least if self.lengths else np.zeros(len(some), bool)
            for k, of in self.short_hashes.items():
                many |= np.diff(np.searchsorted(start[np.flatnonzero(np.isin(shingles(h, k), of))], first)) > 0
            for i in np.flatnonzero(many):
                out[at + i] = self.hits(texts[at + i])
            at = to
        return out


#: Bytes of the benchmark's texts that one pass over the documents takes.
BLOCK_BYTES = 16 << 20


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, block_items: int = 20_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "benchmark_hits") -> DataFrame:
    """All columns of ``docs`` and ``benchmark_hits``: for each item that a window of the text is similar to, the best window (first word, words, similarity).

    The benchmark goes to the executors in blocks of about ``block_items`` items and BLOCK_BYTES bytes. One block is broadcast; of several each has a pass of its own
    over the texts, whose hits are written before the next block is read, so that driver and workers hold one at a time whatever the benchmark's size. Words are runs of ASCII
    letters, digits, underscores and non-ASCII characters, lower-cased. An item of fewer than n words is found where all its words stand in a row; one without words never. Null and
    empty texts have no hits; repeated rows and items give each their own; a column of the output's name is replaced; other names pass through, dots and all;
    an empty benchmark gives no hits, an empty table no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), named(item_text_col).cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // block_items), -(-size.bytes // BLOCK_BYTES))
    own = [c for c in docs.columns if c != out_col]

    def find(block: int):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a block
        return _finder(spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows]), n, threshold)

    if blocks == 1:
        return docs.select(*[named(c) for c in own], find(0)(named(text_col).cast("string")).alias(out_col))
    key = unused("key", own)
    keyed = written(docs.select(*[named(c) for c in own], F.monotonically_increasing_id().alias(key)), "keyed-documents")
    parts = []
    for block in range(blocks):
        found = keyed.select(key, find(block)(named(text_col).cast("string")).alias("hits"))
        parts.append(written(found.filter(F.size("hits") > 0), "block-hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy(key).agg(F.flatten(F.collect_list("hits")).alias(out_col))  # a document's own hits
    return keyed.join(every, key, "left").select(*[named(c) for c in own], F.coalesce(out_col, F.array().cast(HITS)).alias(out_col))


def _finder(shared, n: int, threshold: float):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value, n, threshold)  # once for a task
        for texts in batches:
            yield pd.Series(index.hits_of(texts.tolist()), dtype=object)

    return F.pandas_udf(find, HITS)
