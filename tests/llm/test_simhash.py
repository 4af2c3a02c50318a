import re
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from chunklore.llm import simhash
from chunklore.llm.components import connected_components
from chunklore.llm.queries import op10_simhash_ball

from . import cases


def plain_fp(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, radius=2):
    fps = [plain_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_odd_rows(spark):
    found = simhash.near_duplicates(cases.frame(spark))
    assert sorted(map(tuple, found.collect()), key=str) == plain([(r[0], r[1]) for r in cases.rows()])


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_simhash_ball(spark, sf).collect()), key=str) == plain(docs)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_keep_all_components(spark, radius):
    import random

    rng = random.Random(radius)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.add(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = connected_components(simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), radius)).collect()
    label = {x: x for x in signed} | {r.node: r.component for r in found}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(signed, 2):
        if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= radius:
            parent[root(a)] = root(b)
    for a, b in combinations(signed, 2):
        assert (label[a] == label[b]) == (root(a) == root(b))


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100)}


def test_odd_radius_and_no_rows(spark):
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1,)], "fp long"), 3)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
