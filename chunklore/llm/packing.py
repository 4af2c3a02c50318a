"""Packing documents into fixed-length training sequences.

Pattern packing by non-negative least squares, after the histogram packing of Krell et al. (2021): patterns of a few
binned lengths that fill a sequence are listed, their repeat counts are fitted to the histogram of lengths, rounded, and
what is left over goes into the gaps and then into new sequences, best fit first, longest first. The planning
sees the histogram alone (``seq_len`` rows at most), so the driver's part doesn't grow with the corpus.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, shuffle_parts, tokenizer_path, with_text, written

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenized_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, seq_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text followed by ``end_id``, cut into pieces of ``seq_len`` where longer.

    A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit). Null and empty texts are one
    piece of ``end_id`` alone. Null ids stay null. Repeated rows are pieces of their own. Other columns are ignored. An empty
    table gives no rows.
    """
    importable(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        from .wordcache import encoder

        encode = encoder(tokenizer_path(tokenizer))  # where this worker has it
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
            for at in range(0, len(keys), 64):
                for key, ids in zip(keys[at : at + 64], encode(texts.slice(at, 64).to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * seq_len)):
                        part = ids[start : start + 4 * seq_len]
                        for name, value in zip(out, (key, piece, start // 4, len(part) // 4, part), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=list(out))

    return with_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def patterns(n_bins: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` bins, largest first, whose sum is ``n_bins``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < most:
            for b in range(min(left, top), 0, -1):
                if b * (most - len(head)) < left:
                    break
                extend((*head, b), left - b, b)

    extend((), n_bins, n_bins - 1)
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - y|, by the active-set method of Lawson and Hanson."""
    gram, target = a.T @ a, a.T @ y
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = np.where(free, -np.inf, target - gram @ x)
        if gradient.max(initial=-np.inf) <= small:
            break
        free[int(gradient.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            best = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            bad = best <= 0
            step = np.min(x[at][bad] / (x[at][bad] - best[bad] + 1e-300))
            x[at] += step * (best - x[at])
            drop = at[bad & (x[at] <= small)]
            drop = drop if len(drop) else at[bad][:1]
            x[drop], free[drop] = 0, False
            if not free.any():
                break
    return x


@dataclass
class Plan:
    """Where the k-th piece of each length goes. An entry: (length, first k, pieces a sequence, first sequence, sequences, offset)."""

    seq_len: int
    entries: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, each: int, first: int, sequences: int, offset: int) -> None:
        k = self.used.get(length, 0)
        self.entries.append((length, k, each, first, sequences, offset))
        self.used[length] = k + each * sequences


def plan(histogram: dict[int, int], seq_len: int, bins: int = 128, most: int = 3) -> Plan:
    """A place for every piece counted in ``histogram`` (length -> pieces, 1 <= length <= seq_len)."""
    made, left = Plan(seq_len), {k: n for k, n in sorted(histogram.items(), reverse=True) if n}
    if full := left.pop(seq_len, 0):
        made.put(seq_len, 1, 0, full, 0)
        made.sequences = full
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    gaps: list[int] = []

    def leave(gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in open_:
                bisect.insort(gaps, gap)
            open_.setdefault(gap, []).append((first, sequences))

    width = -(-seq_len // bins)
    queues: dict[int, list[list[int]]] = {}
    for length, n in left.items():
        queues.setdefault(-(-length // width), []).append([length, n])
    there = {b: sum(n for _, n in q) for b, q in queues.items()}
    wanted = [p for p in patterns(seq_len // width, most) if all(b in there for b in p)]
    if wanted:
        rows = sorted(there)
        place = {b: i for i, b in enumerate(rows)}
        matrix = np.zeros((len(rows), len(wanted)))
        for j, p in enumerate(wanted):
            for b in p:
                matrix[place[b], j] += 1
        weight = np.array([0.05 + (b * width / seq_len) for b in rows])  # short pieces fill gaps well: they may stay over
        fitted = nnls(matrix * weight[:, None], np.array([there[b] for b in rows], float) * weight)
        for j in np.argsort(-fitted, kind="stable"):
            p = wanted[j]
            times = min([round(float(fitted[j])), *(there[b] // p.count(b) for b in p)])
            if times <= 0:
                continue
            runs = []
            for b in p:  # the next pieces of each bin, longest first, as runs of one length
                need, run = times, []
                there[b] -= times
                while need:
                    length, n = queues[b][0]
                    got = min(n, need)
                    run.append([length, got])
                    need -= got
                    queues[b][0][1] -= got
                    if not queues[b][0][1]:
                        queues[b].pop(0)
                runs.append(run)
            while times:
                n, at = min(run[0][1] for run in runs), 0
                for run in runs:
                    made.put(run[0][0], 1, made.sequences, n, at)
                    at += run[0][0]
                    run[0][1] -= n
                    if not run[0][1]:
                        run.pop(0)
                leave(seq_len - at, made.sequences, n)
                made.sequences += n
                times -= n
    for length, n in sorted(((length, n) for q in queues.values() for length, n in q), reverse=True):
        while n:
            if (at := bisect.bisect_left(gaps, length)) < len(gaps):
                gap = gaps[at]
                first, sequences = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                gap, first = seq_len, made.sequences
                sequences = -(-n // (seq_len // length))
                made.sequences += sequences
            each = min(gap // length, n)
            filled = min(sequences, n // each)
            made.put(length, each, first, filled, seq_len - gap)
            leave(gap - each * length, first, filled)
            leave(gap, first + filled, sequences - filled)
            n -= each * filled
    return made


def packed(pieces: DataFrame, seq_len: int = 4096, bins: int = 128, most: int = 3) -> DataFrame:
    """``pieces`` (doc_id, piece, length of 1 to ``seq_len``, any more columns) with sequence_id and offset.

    Pieces of one length are numbered in salted groups, as many as the length's share of all pieces asks for; so a length that a
    third of the pieces has is no single task's. Repeated rows get a place each. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    importable(spark)
    pieces = written(pieces, "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most seq_len rows
    made = plan(histogram, seq_len, bins, most)
    share = max(1, -(-sum(histogram.values()) // (4 * shuffle_parts(spark))))
    salts = {length: -(-n // share) for length, n in histogram.items()}  # in all at most seq_len + 4 x partitions
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    n_salts = F.broadcast(spark.createDataFrame([(k, s) for k, s in salts.items()] or [(0, 1)], "length long, n_salts long"))
    salted = pieces.join(n_salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("n_salts"))).drop("n_salts")
    counts = sorted((r.length, r.salt, r["count"]) for r in salted.groupBy("length", "salt").count().collect())
    bases, before, last = [], 0, None
    for length, salt, n in counts:
        before = 0 if length != last else before
        bases.append((length, salt, before))
        before, last = before + n, length
    base = F.broadcast(spark.createDataFrame(bases or [(0, 0, 0)], "length long, salt long, base long"))
    entries = np.array(sorted(made.entries) or [(0, 0, 1, 0, 0, 0)], dtype=np.int64)
    shared = spark.sparkContext.broadcast(entries)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        e = shared.value
        keys = (e[:, 0] << 46) + e[:, 1]
        n, k = length.to_numpy(np.int64), k.to_numpy(np.int64)
        row = e[np.searchsorted(keys, (n << 46) + k, "right") - 1]
        nth = k - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 5] + nth % row[:, 2] * n})

    within = Window.partitionBy("length", "salt").orderBy(*order)
    numbered = salted.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    placed = numbered.withColumn("place", place(F.col("length"), F.col("nth") + F.col("base")))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")
