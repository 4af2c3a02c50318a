"""Near copies against brute-force Jaccard similarity of five-word shingles."""

from itertools import combinations

import corpus_pipeline as cp
from chunklore.llm import similar

from . import cases


def plain_shingles(text):
    blanks = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(blanks).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, threshold=0.8):
    """The component's smallest id for each row."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(text, step):
    return " ".join("changed" if i % step == step - 1 else w for i, w in enumerate(text.split()))


def test_odd_rows(spark):
    found = similar.similar_groups(cases.frame(spark))
    assert found.columns == [*cases.frame(spark).columns, "component_id", "stays"]
    assert sorted(cases.collected(found, "doc_id", "component_id"), key=str) == plain([(r[0], r[1]) for r in cases.rows()])
    kept = cases.collected(found.filter("stays"), "doc_id", "component_id")
    assert all(d == c for d, c in kept) and len(kept) == len({c for _, c in kept})
    assert similar.similar_groups(cases.empty(spark)).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "x", 7, 8), (2, "a b  c", "y", 9, 8)], "doc_id long, text string, `no.de` string, key int, stays int")
    assert {(r.doc_id, r["no.de"], r.key, r.stays) for r in similar.similar_groups(clash).collect()} == {(1, "x", 7, True), (2, "y", 9, False)}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(cases.collected(similar.similar_groups(docs), "doc_id", "component_id"), key=str) == plain(rows)
    assert {r.doc_id for r in cp.near_copies(spark, docs, sf).collect()} == {c for _, c in plain(rows)}


def test_edited_copies_go(spark, sf):
    base = cases.prose(3, 400)
    rows = [(1, base), (2, edited(base, 70)), (3, edited(base, 90)), (4, edited(base, 12)), (5, cases.prose(4, 400)), (6, "x y"), (7, "X  y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.near_copies(spark, docs, sf).collect()} == {1, 4, 5, 6}


def test_pairs_that_both_miss_the_smallest(spark):
    base = cases.prose(5, 600).split()
    rows = [(k, " ".join(["own%d" % i if 40 * k <= i < 40 * k + 40 else w for i, w in enumerate(base)])) for k in range(8)]
    rows += [(10 + k, " ".join([*base[60 * k :], *("new%d" % i for i in range(60 * k))])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(cases.collected(similar.similar_groups(docs), "doc_id", "component_id"), key=str) == plain(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the similarity, edited all over or in one place: nearly every one is found."""
    import random

    rng, rows = random.Random(11), []
    for k in range(600):
        base = [rng.choice(cases.WORDS) + str(rng.randrange(500)) for _ in range(300)]
        other = list(base)
        if k % 2:
            for i in rng.sample(range(10, 290), 6):
                other[i] = "changed"
        else:
            other = other[:267]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    close = [k for k in range(600) if 0.8 <= similar.jaccard(similar.shingle_set(rows[2 * k][1]), similar.shingle_set(rows[2 * k + 1][1])) < 0.92]
    assert len(close) > 500
    found = dict(cases.collected(similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id"))
    caught = sum(found[2 * k + 1] == 2 * k for k in close)
    print("FIG pairs caught", caught, "of", len(close))
    assert caught >= 0.995 * len(close)
