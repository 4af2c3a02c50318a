import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklore.llm import repeats, suffixarray
from chunklore.llm.queries import op6_suffix_array_repeats
from chunklore.llm.suffixarray import permuted_prefixes, suffix_array

from . import cases


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 4))
def test_suffix_array_and_prefixes(part, times):
    t = part * times
    sa = suffix_array(np.array(t, np.int64))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    if t:
        prefix = permuted_prefixes(np.array(t), sa)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert prefix[b] == n


def order_by_doubling(t):
    rank, step = np.unique(t, return_inverse=True)[1], 1
    while len(set(rank.tolist())) < len(t):
        follow = np.append(rank[step:], np.full(min(step, len(t)), -1))
        rank = np.unique(np.stack([rank, follow], 1), axis=0, return_inverse=True)[1].ravel()
        step *= 2
    return np.argsort(rank).tolist()


def test_names_are_ordered_by_recursion(monkeypatch):
    """Every level sorts the names of the one above by the same induction, down to names that are all different."""
    levels = []
    inner = suffixarray.suffix_array
    monkeypatch.setattr(suffixarray, "suffix_array", lambda t: (levels.append((len(t), int(t.max()) + 1)), inner(t))[1])
    words, deepest = " ".join(cases.prose(i, 60) for i in range(120)).encode(), 0
    g = np.random.default_rng(3)
    for t in (np.frombuffer(words, np.uint8).astype(np.int64), np.tile(g.integers(0, 300, 97), 60), g.integers(0, 4, 30_000), np.repeat(g.integers(0, 9, 300), g.integers(1, 90, 300))):
        levels.clear()
        assert suffixarray.suffix_array(t).tolist() == order_by_doubling(t)
        sizes = [n for n, _ in levels]
        deepest = max(deepest, len(sizes))
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    assert deepest >= 3


@pytest.mark.parametrize("text", [b"a" * 50_000, b"ab" * 25_000, b"abcabd" * 9_000])
def test_periodic_texts_are_no_exception(text):
    t = np.frombuffer(text, np.uint8).astype(np.int64)
    assert suffix_array(t).tolist() == order_by_doubling(t)


def test_texts_of_a_megabyte(spark):
    """Long texts that share long passages, alone in their groups, against sets of strings."""
    g = np.random.default_rng(9)
    made = lambda n: "".join(g.choice(list("abcdefghij "), n))
    shared, rows = made(200_000), []
    for i in range(3):
        rows.append((i, made(400_000) + shared + made(300_000) + "-" * 100_000))
    rows += [(10, shared[5:90]), (11, "-" * 60), (12, made(300))]
    found = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].n_removed for i in (10, 11, 12)] == [85, 60, 0] and found[0].n_removed == 0
    for i in (1, 2):
        assert [(s.end - s.start) // 1000 for s in found[i].spans] == [200, 100] and found[i].n_bytes == 1_000_000


def plain(rows, length):
    first = {}
    big = 1 << 63
    texts = [(big if d is None else d, d, (x or "").encode()) for d, x in rows]
    for key, _, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def test_odd_rows(spark):
    assert result(repeats.without_repeats(cases.frame(spark), group_rows=3, group_bytes=900)) == plain([(r[0], r[1]) for r in cases.rows()], 50)


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcd "), 400)) for _ in range(4)]
    rows = []
    for i in range(60):
        a, b = rng.integers(0, 4, 2)
        x, y = rng.integers(0, 300, 2)
        rows.append((int(rng.integers(0, 40)), base[a][x : x + 90] + "".join(rng.choice(list("xyz"), 20)) + base[b][y : y + int(rng.integers(20, 100))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.without_repeats(docs, group_rows=7, group_bytes=[1 << 20, 400, 1][seed], many_groups=[64, 1, 3][seed])) == plain(rows, 50)


def test_pieces_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab"), 300)).encode() for _ in range(5)] + [b"ab" * 200]
    want = {(i, a + k, h) for i, t in enumerate(texts) for i_, a, b, h in zip(*[x.tolist() for x in repeats.runs([t], 50)]) for k in range(b - a + 1)}
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "BLOCK", 100)
    got = {(i, a + k, h) for i, a, b, h in zip(*[x.tolist() for x in repeats.runs(texts, 50)]) for k in range(b - a + 1)}
    assert got == want
    assert {(i, x) for i, x, _ in got} == {(i, x) for i, t in enumerate(texts) for x in range(len(t) - 49)}


def test_texts_are_sent_by_no_shuffle(spark):
    """Groups lie in buckets: of a step's two inputs only what is addressed to groups goes through a shuffle."""
    docs = spark.createDataFrame([(i, cases.prose(i % 7, 80)) for i in range(30)], "doc_id long, text string")
    plan = repeats.without_repeats(docs, group_rows=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(g#") == 1 and "Bucketed: true" in plan


def test_chance_grams_are_not_sent(spark):
    """Words of a small vocabulary, as in a large corpus: phrases of 16 bytes and more come again in most groups, strings of 50 bytes don't. No segments are sent for them."""
    g = np.random.default_rng(8)
    rows = [(i, " ".join(g.choice(["of the", "and that", "to all", "in this", "by some", "at his", "from it", "as her"], 60))) for i in range(48)]
    texts = [t.encode() for _, t in rows]
    several = lambda n: np.mean([sum(t[k : k + n] in x for x in texts) > 1 for t in texts for k in range(0, len(t) - 50, 25)])
    assert several(16) > 0.9 and several(50) < 0.05
    text, first, last, h = repeats.runs(texts, 50)
    again = {x for x in h.tolist() if len(set(text[h == x].tolist())) > 1}
    assert sum(x in again for x in h.tolist()) < 0.4 * len(h)
    values = repeats.marked(np.array([5, 9, 9, 9, 9, 12, 12], np.uint64), np.array([0, 1, 2, 3, 4, 6, 6]))
    assert [(int(x) >> repeats.SPARE, int(x) >> 1 & 15, int(x) & 1) for x in values] == [(5, 0, 0), (9, 2, 1), (12, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.without_repeats(docs, group_rows=1, many_groups=20)) == plain(rows, 50)


def test_hashes_of_many_groups_with_few_runs_stay_whole():
    """A hash is dealt string by string for the memory that its segments need, not for the number of groups alone, which grows with the corpus."""
    one = repeats.marked(np.array([7], np.uint64), np.array([0]))
    full = repeats.marked(np.full(40_000, 7, np.uint64), np.arange(40_000))
    hot = lambda values: (repeats.met_again(np.concatenate(values), np.arange(len(values)), 256)[0] & np.uint64(1)).tolist()
    assert hot([one]) == [] and hot([one] * 5000) == [0] * 5000 and hot([one] * 40_000) == [1] * 40_000 and hot([full, full, one]) == [1] * 3


def test_no_rows(spark):
    assert repeats.without_repeats(cases.empty(spark)).count() == 0


def test_query(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, op6_suffix_array_repeats(spark, sf).collect()))
    assert found == sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in plain(docs, 50))
