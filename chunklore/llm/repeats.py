"""Byte strings that documents share, found by suffix arrays over shards.

A shared string of ``length`` bytes shares the smallest hash of its 32-byte grams, so runs of starts with one such hash
(a segment: their bytes) can be dealt by it. Hashes met in one document alone are sorted out first; grams are so long because much shorter ones come again by chance in a large corpus,
of which more and more would be sent. Each shard then
holds the distinct segments of its hashes with the smallest document of each; their suffix array and permuted common prefixes give
every start the smallest document that has its string. Copies meet as one segment before any sorting.

Before that, content-defined chunks of which a smaller document has all bytes are settled by their digests, so that copies cost neither segments nor
sorting: the smallest document with a string is never in such a chunk. Documents are numbered into small groups once and
written in buckets by group, where later steps read them without a shuffle; all that is sent back is addressed to a group.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop, importable, shuffle_parts, with_text, written
from .suffixarray import permuted_prefixes, suffix_array
from .wordhash import mixed

#: Bytes of text hashed at a time; most of a long text in one piece; most in one suffix array unless one hash has more.
BLOCK, PIECE, SHARD = 1 << 18, 1 << 20, 1 << 21
NO_ID = (1 << 63) - 1
BLOBS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("g", pa.int64()), ("blob", pa.binary())])
#: Kinds of blobs: chunk digests and their smallest documents, gram hashes, segments, smallest documents by start.
CHUNKS, HASHES, SEGMENTS, HOLDERS = range(4)
#: A chunk has about so many starts.
CHUNK = 192
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"
_VALUE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
#: Low bits of a hash give way to what a group knows of it: whether several documents have it, and the power of two of its runs.
SPARE = 5


def gram_size(length: int) -> int:
    """The largest power of two up to two thirds of a string: 32 of 50 bytes."""
    return 1 << (2 * length // 3).bit_length() - 1


def _blocks(texts: list[bytes], length: int):
    """Texts of at least ``length`` bytes, in pieces of so many starts, put together to blocks: (text, place in it) of each piece, where in the block it begins, its size, and the hash of
    every gram in the block."""
    pieces = [(i, at, t[at : at + PIECE + length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), PIECE) if len(t) - at >= length]
    while pieces:
        some, size = [], 0
        while pieces and (size < BLOCK or not some):
            some.append(pieces.pop())
            size += len(some[-1][2])
        sizes = np.array([len(p) for _, _, p in some])
        h = _VALUE[np.frombuffer(b"".join(p for _, _, p in some), np.uint8)]
        step = 1
        while step < gram_size(length):
            h = h[:-step] * np.uint64(pow(_FACTOR, step, 1 << 64)) + h[step:]
            step *= 2
        yield np.array([i for i, _, _ in some]), np.array([at for _, at, _ in some]), np.cumsum(sizes) - sizes, sizes, h


def chunks(texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(text, first start, end of starts) of all chunks: the bytes near a start alone say whether a chunk begins there."""
    marks = [np.array([[i, 0] for i, t in enumerate(texts) if len(t) >= length], np.int64).reshape(-1, 2)]
    for text, shift, first, sizes, h in _blocks(texts, length):
        at = np.flatnonzero((h >> np.uint64(48)) % np.uint64(CHUNK) == 0)
        own = np.searchsorted(first, at, "right") - 1
        place = at - first[own]
        good = place + length <= sizes[own]
        marks.append(np.stack([text[own], place + shift[own]], 1)[good])
    every = np.unique(np.concatenate(marks), axis=0)
    last = np.append(every[1:, 0] != every[:-1, 0], True)[: len(every)]
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.where(last, sizes[every[:, 0]] - length + 1, np.append(every[1:, 1], 0)[: len(every)])
    return list(zip(every[:, 0].tolist(), every[:, 1].tolist(), end.tolist(), strict=True))


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, hash) of all maximal runs of starts whose strings of ``length`` bytes have one smallest gram hash."""
    found = []
    for text, shift, first, sizes, h in _blocks(texts, length):
        grams, step = length - gram_size(length) + 1, 1
        while 2 * step <= grams:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if grams > step:
            h = np.minimum(h[: len(h) - (grams - step)], h[grams - step :])
    # h: one for each start in the block; starts that run over a piece's end aren't any
        new = np.empty(len(h), bool)
        new[0], new[1:] = True, h[1:] != h[:-1]
        new[first] = True
        new[(first + sizes - length + 1)[:-1]] = True  # what begins there is none
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(h))
        own = np.searchsorted(first, begin, "right") - 1
        good = begin - first[own] + length <= sizes[own]
        begin, end, own = begin[good], end[good], own[good]
        found.append((text[own], begin - first[own] + shift[own], end - 1 - first[own] + shift[own], h[begin]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h) % np.uint64(buckets)).astype(np.int64)


def _dealt(h: np.ndarray, buckets: int):
    """(bucket, places in h) for every bucket that is there."""
    b = _bucket(h, buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(b[part[0]]), part


class Group:
    """A group's documents. settled: (text, first start, end) of chunks that a smaller document has."""

    def __init__(self, ids: list[int], texts: list[bytes], length: int, replies: list[bytes] | None = None):
        from xxhash import xxh3_128_digest

        self.ids, self.texts, self.length = ids, texts, length
        of = chunks(texts, length)
        digests = [xxh3_128_digest(texts[i][a : b + length - 1]) for i, a, b in of]
        self.smallest: dict[bytes, int] = {}
        for (i, _, _), d in zip(of, digests, strict=True):
            if self.smallest.setdefault(d, ids[i]) > ids[i]:
                self.smallest[d] = ids[i]
        self.settled: list[tuple[int, int, int]] = []
        if replies is not None:
            least = dict(self.smallest)
            for blob in replies:
                data, holder = _unpack(blob, "u1", "i8")
                data = data.tobytes()
                least.update((data[16 * j : 16 * j + 16], d) for j, d in enumerate(holder.tolist()))
            self.settled = [c for c, d in zip(of, digests, strict=True) if least[d] < ids[c[0]]]

    def open_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs that aren't within settled chunks."""
        text, first, last, h = runs(self.texts, self.length)
        if self.settled and len(h):
            sizes = np.array([len(t) + 1 for t in self.texts])
            base = np.cumsum(sizes) - sizes
            step = np.zeros(int(sizes.sum()) + 1, np.int32)
            i, a, b = np.array(self.settled).T
            np.add.at(step, base[i] + a, 1)
            np.add.at(step, base[i] + b, -1)
            np.cumsum(step, out=step)
            there = np.zeros(len(step) + 1, np.int32)
            np.cumsum(step > 0, dtype=np.int32, out=there[1:])
            inside = there[base[text] + last + 1] - there[base[text] + first] == last - first + 1
            text, first, last, h = (x[~inside] for x in (text, first, last, h))
        return text, first, last, h


class Segments:
    """The distinct segments of a group with hashes that are wanted, bucket by bucket in one order for all who ask.

    wanted: hashes without their spare bits; below them one bit that says that the hash has very many runs. Of those every single string is a segment,
    dealt by all of its bytes: contexts of a passage that all documents share would else meet in one bucket.
    """

    def __init__(self, group: Group, wanted: np.ndarray, buckets: int):
        from xxhash import xxh3_64_intdigest

        ids, texts, length = group.ids, group.texts, group.length
        text, first, last, h = group.open_runs()
        wanted = np.sort(wanted)
        self.places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        if len(wanted) and len(h):
            h = h >> np.uint64(SPARE)
            at = np.minimum(np.searchsorted(wanted >> np.uint64(1), h), len(wanted) - 1)
            keep = wanted[at] >> np.uint64(1) == h
            for i, a, b, x in zip(text[keep].tolist(), first[keep].tolist(), last[keep].tolist(), wanted[at][keep].tolist(), strict=True):
                if x & 1:
                    for k in range(a, b + 1):
                        self.places.setdefault((x, texts[i][k : k + length]), []).append((i, k))
                else:
                    self.places.setdefault((x, texts[i][a : b + length]), []).append((i, a))
        keys = sorted(self.places)
        self.parts = [(b, [keys[j] for j in part]) for b, part in _dealt(np.array([xxh3_64_intdigest(t) if x & 1 else x for x, t in keys], np.uint64), buckets)]
        self.smallest = {key: min(ids[i] for i, _ in of) for key, of in self.places.items()}


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([struct.pack("<I", len(arrays)), *[struct.pack("<Q", a.nbytes) for a in arrays], *[a.tobytes() for a in arrays]])


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    sizes, at, out = struct.unpack_from(f"<{n}Q", blob, 4), 4 + 8 * n, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _trim() -> None:
    """Gives freed memory back to the system: a worker's heap else keeps the size of its largest group."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), BLOBS.types, strict=True)] if rows else [pa.array([], t) for t in BLOBS.types], schema=BLOBS)


def smallest_holders(segments: list[tuple[int, bytes]], holders: list[int], length: int) -> list[np.ndarray]:
    """For distinct (hash, bytes), in the order of their hashes, and the smallest document of each: by start the smallest document of any segment that has the string."""
    out = [np.full(len(x) - length + 1, d, np.int64) for (_, x), d in zip(segments, holders, strict=True)]
    shard: list[int] = []
    size = at = 0
    while at < len(segments):
        to = at + 1
        while to < len(segments) and segments[to][0] == segments[at][0]:
            to += 1
        if to - at > 1:  # else no other segment can have its strings
            own = sum(len(segments[i][1]) for i in range(at, to))
            if shard and size + own > SHARD:
                _settle([segments[i][1] for i in shard], [out[i] for i in shard], length)
                shard, size = [], 0
            shard += range(at, to)
            size += own
        at = to
    if shard:
        _settle([segments[i][1] for i in shard], [out[i] for i in shard], length)
    return out


def _settle(texts: list[bytes], least: list[np.ndarray], length: int) -> None:
    """least: by start of each text, holds its own document and gets the smallest one. Stretches of strings whose hashes come twice are cut out, equal ones count once, and what is left is
    sorted."""
    sizes = np.array([len(x) for x in texts])
    starts = sizes - length + 1
    first = np.cumsum(sizes) - sizes
    h, step = _VALUE[np.frombuffer(b"".join(texts), np.uint8)], 1
    total, done = np.zeros(len(h) + 1, np.uint64), 0
    while step <= length:  # the hash of ``length`` bytes from those of 1, 2, 4 ...
        if length & step:
            n = len(h) - done
            total = total[:n] * np.uint64(pow(_FACTOR, step, 1 << 64)) + h[done:]
            done += step
        if 2 * step <= length:
            h = h[:-step] * np.uint64(pow(_FACTOR, step, 1 << 64)) + h[step:]
        step *= 2
    own = np.repeat(np.arange(len(texts)), starts)
    place = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    values = total[first[own] + place]
    order = np.argsort(values)
    equal = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values) + 1, bool)
    shared[order] = np.append(equal, False) | np.append(False, equal)
    begin = np.flatnonzero(shared[:-1] & ~(np.append(False, shared[:-2]) & np.append(False, own[1:] == own[:-1])))
    end = np.flatnonzero(shared[:-1] & ~(shared[1:] & np.append(own[1:] == own[:-1], False)))
    stretches: dict[bytes, int] = {}
    asked = []
    for i, a, b in zip(own[begin].tolist(), place[begin].tolist(), place[end].tolist(), strict=True):
        x = texts[i][a : b + length]
        asked.append((i, a, b + 1, x))
        if stretches.setdefault(x, d := int(least[i][0])) > d:
            stretches[x] = d
    if stretches:
        found = dict(zip(stretches, _sorted(list(stretches), list(stretches.values()), length), strict=True))
        for i, a, b, x in asked:
            least[i][a:b] = found[x]


def _sorted(texts: list[bytes], holders: list[int], length: int) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in texts])
    first = np.cumsum(sizes + 1) - sizes - 1
    t = np.zeros(int(first[-1] + sizes[-1] + 1), np.int64)  # 0 ends each text
    inside = np.ones(len(t), bool)
    inside[first + sizes] = False
    t[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sa = suffix_array(t)
    prefix = permuted_prefixes(t, sa)[sa]
    group = np.flatnonzero(np.append(True, prefix[1:] < length))  # suffixes that share ``length`` bytes lie together
    holder = np.repeat(np.array(holders, np.int64), sizes + 1)
    least = np.empty(len(t), np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(holder[sa], group), np.diff(np.append(group, len(t))))
    return [least[a : a + n - length + 1] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def _texts(table) -> tuple[list[int], list[bytes]]:
    ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
    return ids, [x.encode("utf-8", "surrogatepass") for x in table.column("text").to_pylist()]


def grouped(rows: DataFrame, most_bytes: int, most_rows: int, length: int, buckets: int) -> DataFrame:
    """doc_id, text, g, chunks: groups of neighbouring rows, closed when they have so many bytes or rows, so that a worker holds so much at a time (or one longer text). The first row of each has the
    digests of the group's chunks and their smallest documents, by bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("g", pa.int64()), ("chunks", pa.list_(pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])))])

    def closed(parts: list[pa.RecordBatch], g: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        found = Group(*_texts(table), length).smallest
        data, holder = list(found), np.array(list(found.values()), np.int64)
        low = np.frombuffer(b"".join(data), np.uint64)[::2]
        blobs = [{"bucket": b, "blob": _pack(np.frombuffer(b"".join(data[j] for j in at), np.uint8), holder[at])} for b, at in _dealt(low, buckets)]
        n = table.num_rows
        columns = [table.column("doc_id").cast(pa.int64()), table.column("text").cast(pa.string()), pa.array(np.full(n, g)), pa.array([blobs] + [[]] * (n - 1), schema.field("chunks").type)]
        return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()[0]

    def deal(batches):
        from pyspark import TaskContext

        g, size, n, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, before + most_bytes - size, "right")), at + most_rows - n)
                to = at + 1 if to <= at and not n else to
                if to > at:
                    parts.append(batch.slice(at, to - at))
                    size, n = size + int(ends[to - 1]) - before, n + to - at
                if to < batch.num_rows:
                    yield closed(parts, g)
                    g, size, n, parts = g + 1, 0, 0, []
                at = max(at, to)
        if parts:
            yield closed(parts, g)

    return rows.mapInArrow(deal, "doc_id long, text string, g long, chunks array<struct<bucket:int,blob:binary>>")


def without_repeats(docs: DataFrame, length: int = 50, group_bytes: int = 4 << 20, group_rows: int = 4096, many_groups: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs of bytes), kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller doc_id; judged on the input. Rows of one
    doc_id don't remove each other's (``many_groups``: a hash with more runs than so many groups with half as many each is dealt string by string). Groups hold ``group_bytes`` and ``group_rows`` at most, or one longer text, so that a
    worker's memory goes with these, and with the longest text. A null id counts as larger than any. Null text is empty; texts shorter than ``length`` stay whole;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    buckets = shuffle_parts(spark)
    made = bucketed(grouped(with_text(docs, id_col, text_col), group_bytes, group_rows, length, buckets), "grouped-documents", "g", buckets)
    rows = made.select("doc_id", "text", "g")

    def of_kind(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: x for k, b, x in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True) if k == kind}

    def held(table: pa.Table) -> pa.Table:
        _trim()
        least: dict[bytes, int] = {}
        asked = []
        for blob in table.column("blob").to_pylist():
            data, holder = _unpack(blob, "u1", "i8")
            data = data.tobytes()
            asked.append([(data[16 * j : 16 * j + 16], d) for j, d in enumerate(holder.tolist())])
            for x, d in asked[-1]:
                if least.setdefault(x, d) > d:
                    least[x] = d
        out = []
        for bucket, g, pairs in zip(table.column("bucket").to_pylist(), table.column("g").to_pylist(), asked, strict=True):
            if others := [(x, least[x]) for x, d in pairs if least[x] < d]:
                out.append((CHUNKS, bucket, g, _pack(np.frombuffer(b"".join(x for x, _ in others), np.uint8), np.array([d for _, d in others], np.int64))))
        return pa.Table.from_batches([_rows(out)])

    def hashes(left: pa.Table, right: pa.Table) -> pa.Table:
        _trim()
        if not left.num_rows:
            return pa.Table.from_batches([_rows([])])
        text, _, _, h = Group(*_texts(left), length, list(of_kind(right, CHUNKS).values())).open_runs()
        values, g = marked(h >> np.uint64(SPARE), text), left.column("g")[0].as_py()
        return pa.Table.from_batches([_rows([(HASHES, b, g, values[at].tobytes()) for b, at in _dealt(values >> np.uint64(SPARE), buckets)])])

    def repeated(table: pa.Table) -> pa.Table:
        _trim()
        blobs = [np.frombuffer(x, np.uint64) for x in table.column("blob").to_pylist()]
        g = table.column("g").to_numpy()
        values, own = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        key, own = met_again(values, own, many_groups)
        by = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[by], np.arange(len(blobs) + 1))
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches([_rows([(HASHES, bucket, int(g[i]), key[by[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])])

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        _trim()
        wanted = of_kind(right, HASHES)
        if not left.num_rows or not wanted:
            return pa.Table.from_batches([_rows([])])
        group = Group(*_texts(left), length, list(of_kind(right, CHUNKS).values()))
        own = Segments(group, np.concatenate([np.frombuffer(x, np.uint64) for x in wanted.values()]), buckets)
        g = left.column("g")[0].as_py()
        return pa.Table.from_batches([_rows([(SEGMENTS, b, g, _pack(np.array([x for x, _ in keys], np.uint64), np.array([own.smallest[k] for k in keys], np.int64), np.array([len(x) for _, x in keys], np.uint32), np.frombuffer(b"".join(x for _, x in keys), np.uint8))) for b, keys in own.parts])])

    def sorted_(table: pa.Table) -> pa.Table:
        _trim()
        at: dict[tuple[int, bytes], int] = {}
        asked = []
        for blob in table.column("blob").to_pylist():
            h, holder, size, data = _unpack(blob, "u8", "i8", "u4", "u1")
            data, end = data.tobytes(), np.cumsum(size, dtype=np.int64)
            keys = [(x, data[b - n : b]) for x, b, n in zip(h.tolist(), end.tolist(), size.tolist(), strict=True)]
            asked.append(keys)
            for key, d in zip(keys, holder.tolist(), strict=True):
                if at.setdefault(key, d) > d:
                    at[key] = d
        order = sorted(at)
        least = dict(zip(order, smallest_holders(order, [at[k] for k in order], length), strict=True))
        out = []
        for bucket, g, keys in zip(table.column("bucket").to_pylist(), table.column("g").to_pylist(), asked, strict=True):
            every = np.concatenate([least[k] for k in keys])
            new = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            h = np.unique(np.array([x for x, _ in keys], np.uint64))
            out.append((HOLDERS, bucket, g, _pack(h, np.diff(np.append(new, len(every))).astype(np.uint32), every[new])))
        return pa.Table.from_batches([_rows(out)])

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        _trim()
        group = Group(*_texts(left), length, list(of_kind(right, CHUNKS).values()))
        ids, texts = group.ids, group.texts
        marks: dict[int, list[np.ndarray]] = {}
        for i, a, b in group.settled:
            marks.setdefault(i, []).append(np.arange(a, b))
        if held_by := of_kind(right, HOLDERS):
            answers = {b: _unpack(x, "u8", "u4", "i8") for b, x in held_by.items()}
            own = Segments(group, np.unique(np.concatenate([a[0] for a in answers.values()])), buckets)
            for b, keys in own.parts:
                least, at = np.repeat(answers[b][2], answers[b][1]), 0
                for key in keys:
                    n = len(key[1]) - length + 1
                    for i, start in own.places[key]:
                        gone = np.flatnonzero(least[at : at + n] < ids[i])
                        if len(gone):
                            marks.setdefault(i, []).append(gone + start)
                    at += n
        out: dict[str, list] = {name: [] for name in schema.names}
        for i, (key, data) in enumerate(zip(left.column("doc_id").to_pylist(), texts, strict=True)):
            spans: list[tuple[int, int]] = []
            if i in marks:
                start = np.sort(np.concatenate(marks[i]))
                new = np.flatnonzero(np.append(True, start[1:] > start[:-1] + length))
                spans = list(zip(start[new].tolist(), (start[np.append(new[1:] - 1, len(start) - 1)] + length).tolist(), strict=True))
            edge = [0, *[x for s in spans for x in s], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)) if spans else data
            for name, value in zip(out, (key, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                out[name].append(value)
        return pa.Table.from_pydict(out, schema=schema)

    kind = "kind int, bucket int, g long, blob binary"
    by_group = rows.groupBy("g")
    dealt = made.select("g", F.explode("chunks").alias("c")).select(F.lit(CHUNKS).alias("kind"), "c.bucket", "g", "c.blob")
    holders = written(dealt.groupBy("bucket").applyInArrow(held, kind), "chunk-holders")
    again = written(by_group.cogroup(holders.groupBy("g")).applyInArrow(hashes, kind).groupBy("bucket").applyInArrow(repeated, kind), "repeated-hashes")
    answers = written(by_group.cogroup(holders.unionByName(again).groupBy("g")).applyInArrow(sent, kind).groupBy("bucket").applyInArrow(sorted_, kind), "segment-holders")
    drop(again)
    return by_group.cogroup(holders.unionByName(answers).groupBy("g")).applyInArrow(cut, RESULT)


def met_again(values: np.ndarray, own: np.ndarray, many_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Of groups' marked hashes those that several documents have, and whose each is: shifted, with one bit that says that there are very many runs."""
    order = np.argsort(values >> np.uint64(SPARE), kind="stable")
    key = (values >> np.uint64(SPARE))[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    again = np.repeat((size > 1) | (np.maximum.reduceat(values[order] & np.uint64(1), new) > 0), size)
    runs_of = np.add.reduceat(1 << ((values[order] >> np.uint64(1)) & np.uint64(15)).astype(np.int64), new)  # at least half of them
    key = key << np.uint64(1) | np.repeat(runs_of > many_groups**2 // 2, size).astype(np.uint64)
    return key[again], own[order][again]


def marked(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each distinct h, in order, above SPARE bits: the lowest says whether several texts have it, the others the power of two of its runs."""
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    many = np.diff(np.append(new, len(h)))
    last = np.append(new[1:] - 1, len(h) - 1)[: len(new)]
    power = np.minimum(np.frexp(many)[1] - 1, 15).astype(np.uint64)
    return h[new] << np.uint64(SPARE) | power << np.uint64(1) | (text[new] != text[last]).astype(np.uint64)
