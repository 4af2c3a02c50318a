import random
from collections import Counter

import numpy as np

from chunklore.llm import decontaminate as d
from chunklore.llm.queries import op9_benchmark_decontamination
from chunklore.llm.wordhash import words

from . import cases


def tokens(text):
    data = (text or "").lower().encode()
    s, e, _ = words(data)
    return [data[a:b] for a, b in zip(s, e)]


def plain(text, items, n=5, t=0.8):
    w, out = tokens(text), set()
    grams = lambda x: Counter(tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1)))
    for item_id, item in items:
        q = tokens(item)
        if not q:
            continue
        own = grams(q)
        for p in range(len(w) - len(q) + 1):
            g = grams(w[p : p + len(q)])
            shared = sum((g & own).values())
            if shared / (g.total() + own.total() - shared) >= t:
                out.add(item_id)
                break
    return out


def test_against_every_window():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)))) for i in range(30)]
    items += [(100, "too short"), (101, ""), (102, None), (103, "a b a b a b a b a b a b")]
    texts = []
    for _ in range(60):
        x = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if rng.random() < 0.7:
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(0, 3)):
                if part:
                    part[rng.choice([0, -1, rng.randrange(len(part))])] = "changed"
            at = rng.randrange(len(x) + 1)
            x[at:at] = part
        texts.append(" ".join(x).upper() if rng.random() < 0.3 else ", ".join(x))
    items += [(200 + k, " ".join(f"w{i}" for i in range(k, k + k % 4 + 1))) for k in range(12)] + [(212, "w3 w4 w5 w6"), (213, "W3, w4 w5 w6")]
    texts += ["", None, "a b " * 30, "this is too short", "w3 w4 w5 w6", "w3 w4 x w5 w6"]
    index = d.Index(items)
    found = index.hits_of(texts)
    assert any(found) and [{h["item_id"] for h in hits} for hits in found] == [plain(t, items) for t in texts]


def test_index_returns_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = d.Index([(i, " ".join(f"t{x}" for x in rng.integers(0, 50, 20))) for i in range(200)])
    at, prints, _ = index.lengths[20]
    windows = prints[rng.integers(0, len(prints), 100)] ^ np.packbits(rng.random((100, 64)) < rng.random((100, 1)) * 0.6, axis=1)
    w, i = index.near(20, windows)
    close = np.unpackbits(windows[:, None] ^ prints[None], axis=2).sum(2) <= d.RADIUS
    assert set(zip(w.tolist(), i.tolist())) == {(x, int(at[y])) for x, y in zip(*np.nonzero(close))}


def test_odd_rows_and_blocks(spark):
    docs = cases.frame(spark)
    items = spark.createDataFrame([(1, cases.prose(2, 200)[:150], 0), (1, cases.prose(2, 200)[:150], 0), (None, cases.prose(1), 1), (3, None, 2), (4, "x", 2)], "item_id long, text string, doc_id int")
    one = d.benchmark_hits(docs, items)
    assert one.columns == docs.columns
    many = d.benchmark_hits(docs, items, block_items=1)
    key = lambda df: sorted(((r.doc_id, r.text, sorted(str(h.item_id) for h in r.benchmark_hits)) for r in df.collect()), key=str)
    assert key(one) == key(many) and one.count() == len(cases.rows())
    hits = {r.doc_id: len(r.benchmark_hits) for r in one.collect()}
    assert hits[2] == 2 and hits[0] == 1 and hits[4] == 0  # a repeated item is found twice
    want = [(i, t) for i, t, _ in ((1, cases.prose(2, 200)[:150], 0), (None, cases.prose(1), 1), (3, None, 2), (4, "x", 2))]
    for r in one.collect():
        assert {h.item_id for h in r.benchmark_hits} == plain(r.text, want)


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "one two three four", 5, 6)], "doc_id long, text string, `a.b` int, key int")
    items = spark.createDataFrame([(1, "two three"), (2, "two four"), (3, "one two three four")], "item_id long, text string")
    for block in (1, 10):
        row = d.benchmark_hits(docs, items, block_items=block).collect()[0]
        assert row["a.b"] == 5 and row.key == 6 and {(h.item_id, h.start, h.n_words, h.similarity) for h in row.benchmark_hits} == {(1, 1, 2, 1.0), (3, 0, 4, 1.0)}


def test_no_rows(spark):
    assert d.benchmark_hits(cases.empty(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0
    out = d.benchmark_hits(cases.frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert out.filter("size(benchmark_hits) > 0").count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in op9_benchmark_decontamination(spark, sf).collect():
        assert set(r.item_ids) >= {i for i, t in items if t and t in docs[r.doc_id]}
        assert r.contaminated == bool(r.item_ids) and set(r.item_ids) == plain(docs[r.doc_id], items)
