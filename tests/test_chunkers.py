"""The numerical chunkers against plain versions written here, and what must always hold of their results."""

from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklore.operators import byrows, grouping, signals
from chunklore.operators.contiguous import Splitter, split
from chunklore.operators.grouping import Grouper, group
from chunklore.plans import registry

rng = np.random.default_rng(0)


def units(n, seed=0):
    return signals.unit_rows(np.random.default_rng(seed).normal(size=(n, 8)))


def test_ranks():
    s = np.round(units(9) @ units(9).T, 1)
    want = [[sum(s[i] < s[i, j]) + sum(s[:, j] < s[i, j]) for j in range(9)] for i in range(9)]
    assert (signals.rank_matrix(s) == want).all()
    local = signals.rank_matrix(s, 5)
    for i in range(9):
        for j in range(9):
            win = s[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3]
            assert np.isclose(local[i, j], (win < s[i, j]).sum() / win.size)


def plain_cuts(r, size, least=0.01):
    segments, cuts = [(0, len(r))], []
    while True:
        options = [(0.5 * (r[a:c, a:c].mean() + r[c:b, c:b].mean()) - r[a:b, a:b].mean(), c, a, b) for a, b in segments for c in range(a + size, b - size + 1)]
        if not options:
            return sorted(cuts)
        gain, c, a, b = max(options, key=lambda o: o[0])
        if gain < max(least, 0.1 * abs(r[a:b, a:b].mean())):
            return sorted(cuts)
        segments.remove((a, b))
        segments += [(a, c), (c, b)]
        cuts.append(c)


@pytest.mark.parametrize("seed", range(8))
def test_divisive_cuts(seed):
    v = units(30, seed)
    v[10:20] = signals.unit_rows(v[10:20] * 0.2 + v[10])
    r = signals.rank_matrix(v @ v.T)
    assert signals.divisive_cuts(r, 3) == plain_cuts(r, 3)
    assert signals.divisive_cuts(r, 16) == []
    assert set(signals.divisive_cuts(r, 3, profile=True)) <= set(range(3, 28))


def plain_valleys(x):
    out, i = [], 1
    while i <= len(x) - 2:
        if x[i] > x[i - 1]:
            i += 1
            continue
        j = i
        while j + 1 <= len(x) - 2 and x[j + 1] <= x[j]:
            j += 1
        if x[j + 1] >= x[j]:
            out.append(i + int(np.argmin(x[i : j + 1])) + 1)
        i = j + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25))
def test_valleys(values):
    x = np.array(values, float)
    assert signals.valleys(x, 0.1, 1, 0) == sorted(set(plain_valleys(x)) if len(x) >= 3 else [])
    spaced = signals.valleys(x, 0.1, 4, 5)
    assert all(b - a >= 4 for a, b in zip(spaced, spaced[1:])) and all(v >= 5 for v in spaced)


def test_series():
    assert signals.valleys(np.ones(2), 0.1, 1, 0) == [] and signals.valleys(np.array([3.0, 1, 3]), 0.1, 1, 0) == [2]
    assert len(signals.valleys(np.array([3, 1, 3, 1, 3.0]), 0.1, 5, 0)) == 1
    x = rng.normal(size=11)
    pad = np.pad(x, 1, mode="edge")
    assert np.allclose(signals.median_smoothed(x, 3), [np.median(pad[i : i + 3]) for i in range(11)])
    assert (signals.median_smoothed(x, 2) == signals.median_smoothed(x, 3)).all() and (signals.median_smoothed(x, 13) == x).all()
    assert signals.spaced([1, 2, 9], {1: 0.2, 2: 0.9, 9: 0.1}, 3) == [2, 9]
    v = units(7, 3)
    mean = lambda a: a.mean(0) / np.linalg.norm(a.mean(0))
    assert np.allclose(signals.window_gaps(v, 4), [1 - mean(v[max(0, i - 3) : i + 1]) @ mean(v[i + 1 : i + 5]) for i in range(6)])
    series = np.array([0, 5, 0, 4, 0, 0.1, 0, 6, 0, 0, 3, 0])
    assert {i: r for i, _, r in signals.peaks(series, 3)} == {1: "SELECTED", 3: "NMS", 5: "NMS", 7: "SELECTED", 10: "SELECTED"}
    assert signals.peaks(np.array([0, 5, 0, 4, 0, 1, 0, 9, 2, 2, 2, 3]), 1) == [(7, 9.0, "SELECTED"), (1, 5.0, "SELECTED"), (3, 4.0, "SELECTED"), (9, 2.0, "FLOOR"), (5, 1.0, "FLOOR")]
    assert signals.diameter_spans(np.eye(1), 0.5) == [(0, 1)] and signals.diameter_spans(np.ones((4, 4)), 0.5) == [(0, 4)]
    assert signals.diameter_spans(np.eye(4), 0.5) == [(i, i + 1) for i in range(4)]


def test_optimal_cuts():
    from itertools import combinations

    adjacent = rng.random(9)
    at = [2, 4, 5, 8]
    value = lambda cuts: sum((adjacent[a : b - 1].mean() if b - a > 1 else 0) for a, b in zip([0, *cuts], [*cuts, 10])) - 0.05 * len(cuts)
    best = max((c for k in range(5) for c in combinations(at, k)), key=value)
    assert np.isclose(value(signals.optimal_cuts(adjacent, at, 0.05)), value(best))


SPLITTERS = [c.how for c in registry.CONFIGS.values() if isinstance(c.how, Splitter)] + [Splitter(auto=False, hybrid="union"), Splitter(auto=False, hybrid="union_weighted", vote=0.5), Splitter(auto=False, stopping="profile")]
GROUPERS = [c.how for c in registry.CONFIGS.values() if isinstance(c.how, Grouper)]


@pytest.mark.parametrize("how", SPLITTERS)
def test_splitters_partition_in_order(how):
    for n in (1, 2, 5, 23, 90):
        sentences = [" ".join(np.random.default_rng(i + n).choice(list("abcdefgh"), 6)) for i in range(n)]
        found = how.groups(sentences)
        assert [i for g in found for i in range(g["first"], g["last"] + 1)] == list(range(n))


@pytest.mark.parametrize("how", GROUPERS)
def test_groups_partition(how):
    for n in (1, 2, 3, 8, 40):
        sentences = [" ".join(np.random.default_rng(i // 4 + n).choice(list("abcdefgh"), 6)) for i in range(n)]
        found = how.groups(sentences)
        assert sorted(i for g in found for i in g["members"]) == list(range(n)) and all(g["exemplar"] in g["members"] for g in found)


@pytest.mark.parametrize("mask", [None, 7])
def test_ranks_by_rows_give_the_same_cuts(mask):
    for seed, n in ((0, 60), (1, 61), (2, 8)):
        v = signals.hashed_vectors([" ".join(np.random.default_rng(i // 9 + seed).choice(list("abcdefgh"), 5)) + f" {i % 4}" for i in range(n)])
        ranks = signals.rank_matrix(signals.similarities(v), mask)
        for most in (0, 1 << 20):
            rows = signals.RankRows(v, mask, most)
            rows.step, rows.kept = 7, [rows._counts(a, min(a + 7, n)).astype(np.uint16) for a in range(0, n, 7)] if most else []
            table = signals.RankTable(ranks)
            for a, b in ((0, n), (3, n - 2)):
                assert all(np.allclose(x, y) for x, y in zip(rows.sums(a, b), table.sums(a, b)))
            assert signals.divisive_cuts(rows, 3) == signals.divisive_cuts(ranks, 3)


def long_document(n, themes=40):
    g = np.random.default_rng(5)
    words = [[f"theme{t}word{i}" for i in range(30)] for t in range(themes)]
    return [" ".join(g.choice(words[(k // 50) % themes], 9)) + f" sentence {k}" for k in range(n)]


def test_long_document_is_split_as_a_whole():
    """4,000 sentences, more than the reference's longest has, by rows and as one matrix."""
    sentences = long_document(4000)
    by_rows, whole = Splitter().groups(sentences), Splitter(whole_matrix=5000).groups(sentences)
    assert by_rows == whole and len(by_rows) > 5
    assert [i for g in by_rows for i in range(g["first"], g["last"] + 1)] == list(range(4000))


def test_groups_reach_over_all_of_a_long_document():
    found = Grouper(auto=False, engine="spectral", knn=10).groups(long_document(1560, 20))
    assert sorted(i for g in found for i in g["members"]) == list(range(1560))
    assert any(min(g["members"]) < 100 and max(g["members"]) >= 1500 for g in found)  # themes come again after 1,000 sentences


def test_groups_reach_over_documents_of_any_length():
    """4,200 sentences, more than one matrix takes: themes come again in the last ones, behind any stretch of 4,096."""
    found = Grouper(auto=False, engine="spectral", knn=6, edge_floor=0.5).groups(long_document(4200, 20))
    assert sorted(i for g in found for i in g["members"]) == list(range(4200))
    assert any(min(g["members"]) < 100 and max(g["members"]) >= 4100 for g in found)


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_rows_are_made_of_what_the_matrix_gives(seed, monkeypatch):
    monkeypatch.setattr(byrows, "CELLS", 1000)
    g = np.random.default_rng(seed)
    v = signals.hashed_vectors([" ".join(g.choice([f"t{k % (3 + seed)}w{i}" for i in range(30)], 8)) for k in range(90)])
    a, b = grouping._Whole(v, 0.15), byrows.Rows(v, 0.15)
    assert np.allclose(a.quantiles(0.2, 0.6, 0.8), b.quantiles(0.2, 0.6, 0.8), rtol=1e-9) and abs(a.spread() - b.spread()) < 1e-9
    assert np.allclose(a.centrality, b.centrality) and np.allclose([a.row(x) for x in range(90)], [b.row(x) for x in range(90)])
    floor = a.quantiles(0.8)[0] + 1e-6
    x, y = a.filtered(3, floor), b.filtered(3, floor)
    assert np.allclose(x, y.rows(0, 90), atol=1e-8) and np.allclose(x.sum(1), y.sum(1))
    edges = b.nearest(6, floor)
    assert np.allclose(a.nearest(6, floor), edges.dense()) and (edges.within([5, 1, 40, 80, 3]).dense() == edges.dense()[np.ix_([5, 1, 40, 80, 3], [5, 1, 40, 80, 3])]).all()
    assert abs(a.total([1, 5, 9], [5, 6, 70, 2]) - b.total([1, 5, 9], [5, 6, 70, 2])) < 1e-9
    for resolution in (0.7, 1.0, 1.6):
        assert (grouping.communities(x, resolution) == grouping.communities(y, resolution)).all()
        degree = x.sum(1)
        own, moved = grouping._moved(x, degree, degree.sum(), resolution)
        assert (np.unique(own, return_inverse=True)[1] == grouping._moved_by_rows(x, degree, degree.sum(), resolution)[0]).all() and moved
    runs = [np.unique(g.integers(0, k, 90) if k > 5 else np.arange(90) * k // 90, return_inverse=True)[1] for k in (2, 3, 4, 2 + 5 * seed)]
    for q in (0.3, 0.5, 0.9):
        share = np.mean([r[:, None] == r for r in runs], axis=0)
        np.fill_diagonal(share, 0.0)
        cut = np.quantile(share[np.triu_indices(90, 1)], q)
        kept, together = np.where(share >= cut, share, 0.0), byrows.Together(runs, q)
        assert abs(together.cut - cut) < 1e-12
        values, vectors = together.lowest(12)
        assert np.allclose(values, np.linalg.eigvalsh(grouping.laplacian(kept))[:12])
        assert np.allclose(grouping.laplacian(kept) @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(12))
    values, vectors = edges.lowest(8)
    assert np.allclose(values, np.linalg.eigvalsh(grouping.laplacian(edges.dense()))[:8]) and np.allclose(grouping.laplacian(edges.dense()) @ vectors, vectors * values, atol=1e-6)


def test_groups_by_rows_find_the_themes_that_the_matrix_finds():
    g = np.random.default_rng(5)
    sentences = [" ".join(g.choice([f"t{k // 10 % 4}w{i}" for i in range(12)], 8)) for k in range(240)]
    for how in (Grouper(), Grouper(auto=False, engine="spectral", knn=6, edge_floor=0.5)):
        whole, rows = how.groups(sentences), replace(how, whole_matrix=8).groups(sentences)
        assert sorted(x["members"] for x in whole) == sorted(x["members"] for x in rows)


def plain_split(sentences):
    """The automatic splitter end to end, in plain loops: what its parts are put together to."""
    v = signals.hashed_vectors(sentences)
    n = len(v)
    adjacent = np.array([v[i] @ v[i + 1] for i in range(n - 1)])
    pad = np.pad(adjacent, 1, mode="edge")
    smooth = np.array([np.median(pad[i : i + 3]) for i in range(n - 1)])
    middle, spread = np.median(smooth), np.median(np.abs(smooth - np.median(smooth))) + 1e-9
    half = np.subtract(*np.percentile(smooth, [75, 25])) / 2
    signal = 1 / (1 + np.exp(-np.clip((smooth - middle) / spread / max(half, 0.05), -500, 500)))
    spacing, first, cap = max(5, round(n / 50)), max(5, round(0.05 * n)), max(24, round(0.12 * n))
    sim = np.round(v @ v.T, 9)
    ranks = np.array([[(sim[i] < sim[i, j]).sum() + (sim[:, j] < sim[i, j]).sum() for j in range(n)] for i in range(n)], float)
    both = sorted(set(plain_cuts(ranks, max(3, spacing)) if n >= 2 * max(3, spacing) else []) & set(signals.valleys(signal, max(half, 0.06), spacing, first)))
    kept = []
    for c in both:
        if all(abs(c - k) >= spacing for k in kept):
            kept.append(c)
    out, start = [], 0
    for stop in [*kept, n]:
        while stop - start > cap and stop - start >= 3:
            options = range(max(start + 1, start + cap - 2), min(stop - 1, start + cap + 2) + 1)
            if len(options) < 2:
                break
            cut = min(options, key=lambda c: (adjacent[c - 1], c))
            start = min(max(cut, first) if start == 0 else cut, stop - 1)
            out.append(start)
        if stop < n:
            out.append(stop)
        start = stop
    moved = sorted({min(range(max(1, c - 2), min(n - 1, c + 2) + 1), key=lambda x: (smooth[x - 1], x)) for c in out})
    sizes = np.diff([0, *moved, n])
    least = max(3, round(float(np.percentile(sizes, 10)))) if len(sizes) >= 5 else 3
    final, start = [], 0
    for c in moved:
        if c - start >= least:
            final.append(c)
            start = c
    return list(zip([0, *final], [*final, n]))


@pytest.mark.parametrize("seed", range(6))
def test_splitter_end_to_end(seed):
    g = np.random.default_rng(seed)
    sentences = [" ".join(g.choice([f"t{k // (7 + seed)}w{i}" for i in range(12)], 7)) for k in range(40 + 17 * seed)]
    assert [(c["first"], c["last"] + 1) for c in Splitter().groups(sentences)] == plain_split(sentences)


def plain_groups(sentences):
    """The automatic grouping end to end, pair by pair; communities and spectral cuts, which have tests of their own, are taken as they are."""
    v = signals.hashed_vectors(sentences)
    n = len(v)
    if n == 1:
        return [[0]]
    raw = v @ v.T
    sharp = np.array([[0.0 if i == j else 1 / (1 + np.exp(-np.clip((raw[i, j] - raw.mean()) / (raw.std() + 1e-9) / 0.15, -500, 500))) for j in range(n)] for i in range(n)])
    positive = sharp[sharp > 0]
    quantile = lambda q, other: float(np.quantile(positive, q)) if len(positive) else other
    k, floor, most = max(5, min(32, round(n * 0.06))), quantile(0.8, 0.25), max(2, min(16, n // 6))
    graph = np.zeros((n, n))
    for i in range(n):
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (-sharp[i, j], j))[: max(1, min(k, n - 1))]:
            if sharp[i, j] >= floor:
                graph[i, j] = graph[j, i] = max(sharp[i, j], graph[i, j])
    values, vectors = np.linalg.eigh((sharp + sharp.T) / 2)
    noise = values[: max(0, n - 3)].mean() if n > 3 else 0.0
    kept = sum((x if i >= n - 3 else noise) * np.outer(vectors[:, i], vectors[:, i]) for i, x in enumerate(values))
    kept = np.array([[0.0 if i == j else max(kept[i, j], kept[j, i], 0.0) for j in range(n)] for i in range(n)])
    kept[kept < floor] = 0
    labels = None
    if n > 2 and not np.allclose(kept, 0):
        runs = [x for x in (grouping.communities(kept, r) for r in np.arange(0.7, 1.6 + 1e-9, 0.15)) if 2 <= len(set(x)) <= max(2, min(most, n - 1))]
        if runs:
            together = np.array([[0.0 if i == j else sum(x[i] == x[j] for x in runs) / len(runs) for j in range(n)] for i in range(n)])
            cut = np.quantile([together[i, j] for i in range(n) for j in range(i + 1, n)], 0.5)
            labels = grouping.spectral(np.where(together >= cut, together, 0.0), most, starts=10, rounds=200)
            labels = runs[-1] if labels is None else labels
    labels = grouping.spectral(graph, most) if labels is None else labels
    found = [list(range(n))] if labels is None else [[i for i in range(n) if labels[i] == c] for c in range(max(labels) + 1)]
    between = lambda a, b: np.mean([sharp[i, j] for i in a for j in b])
    within = lambda a: np.mean([sharp[i, j] for i in a for j in a if i != j]) if len(a) > 1 else 1.0

    def halves(g):
        two = grouping.spectral(graph[np.ix_(g, g)], 2, k=2, seed=1) if len(g) >= 4 else None
        if two is None or len(set(two)) == 1:
            return None
        parts = [[x for x, c in zip(g, two) if c == side] for side in (0, 1)]
        return parts if between(*parts) < (within(parts[0]) + within(parts[1])) / 2 else None

    cut_up = []
    for g in (g for g in found if g):
        parts = halves(g) if len(g) > max(20, n // 4) else None
        cut_up += parts if parts and min(map(len, parts)) >= 2 else [g]
    least = max(2, int(np.percentile([len(g) for g in cut_up], 10))) if len(cut_up) >= 5 else 2
    alive = dict(enumerate(cut_up))
    for i in sorted(alive):
        if i in alive and len(alive[i]) < least:
            gains = [(within(alive[i] + h) - (within(alive[i]) + within(h)) / 2, -j) for j, h in alive.items() if j != i and between(alive[i], h) >= quantile(0.65, 0.38)]
            if gains and max(gains)[0] > 0:
                j = -max(gains)[1]
                alive[j] = sorted(alive[j] + alive.pop(i))
    found = list(alive.values())
    means = [within(g) for g in found]
    low, parts = np.percentile(means, 25) if len(means) >= 2 else 0.0, []
    for g, mean in zip(found, means):
        two = halves(g) if len(g) >= 6 and mean < max(0.5, low) else None
        parts += two if two and min(map(within, two)) > mean else [g]
    found = []
    for g in parts:
        if found and between(found[-1], g) >= max(0.9 * max(1e-6, min(within(found[-1]), within(g))), quantile(0.6, 0.5)):
            found[-1] = sorted(found[-1] + g)
        else:
            found.append(g)
    if len(found) > 1:
        delta = positive.std() * 0.1 if len(positive) else 0.02
        for x in range(n):
            own = next(c for c, g in enumerate(found) if x in g)
            mean = lambda g: np.mean([sharp[x, i] for i in g if i != x]) if set(g) - {x} else 0.0  # noqa: B023, E731
            best, score = own, mean(found[own])
            for c, g in enumerate(found):
                if c != own and mean(g) > score + delta:
                    best, score = c, mean(g)
            if best != own:
                found[own].remove(x)
                found[best].append(x)
    return sorted(sorted(g) for g in found if g)


@pytest.mark.parametrize("seed", range(6))
def test_grouping_end_to_end(seed):
    g = np.random.default_rng(seed + 20)
    sentences = [" ".join(g.choice([f"t{(k // 3) % (3 + seed)}w{i}" for i in range(9)], 6)) + " common" for k in range((1, 9, 24, 41, 60, 77)[seed])]
    assert sorted(x["members"] for x in Grouper().groups(sentences)) == plain_groups(sentences)


@pytest.mark.parametrize("n", [3, 17, 60, 230])
def test_communities_move_alike_by_neighbours_and_by_rows(n):
    g = np.random.default_rng(n)
    for resolution in (0.4, 0.7, 1.0, 1.6):
        w = np.where(g.random((n, n)) < 0.3, np.round(g.random((n, n)), 1 + n % 3), 0.0)
        w = np.maximum(w, w.T)
        degree = w.sum(1)
        by = [grouping._moved(w, degree, degree.sum(), resolution, most) for most in (-1, 20, n)]
        assert all(x.tolist() == by[0][0].tolist() and y == by[0][1] for x, y in by[1:])


def test_communities_of_many_graphs_side_by_side_are_those_of_each():
    g = np.random.default_rng(3)
    asked = []
    for n in (1, 2, 7, 40, 41, 150):
        w = np.where(g.random((n, n)) < 0.4, np.round(g.random((n, n)), 2), 0.0)
        w[: n // 5] = w[:, : n // 5] = 0  # no neighbours
        asked += [(np.maximum(w, w.T), r) for r in (0.4, 1.0, 1.6)]
    for cells in (1, 300, 1 << 14):
        assert [x.tolist() for x in grouping.communities_of(asked, cells)] == [grouping.communities(w, r).tolist() for w, r in asked]


def test_communities_and_spectral_find_blocks():
    w = np.zeros((12, 12))
    for a in (0, 4, 8):
        w[a : a + 4, a : a + 4] = 1
    np.fill_diagonal(w, 0)
    w[3, 4] = w[4, 3] = w[7, 8] = w[8, 7] = 0.05
    for labels in (grouping.communities(w, 1.0), grouping.spectral(w, 6, k=3)):
        assert [len(set(labels[a : a + 4])) for a in (0, 4, 8)] == [1, 1, 1] and len(set(labels)) == 3
    assert grouping.spectral(np.zeros((5, 5)), 3) is None


def test_filters():
    s = units(10, 1) @ units(10, 1).T
    f = grouping.spectrum_filtered(s, 3)
    assert (f == f.T).all() and (f >= 0).all() and (np.diagonal(f) == 0).all()
    g = grouping.nearest_graph(s, 2, 0.1)
    assert (g == g.T).all() and ((g == 0) | (g >= 0.1)).all()
    assert np.allclose(grouping.laplacian(g), grouping.laplacian(g).T)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Delta epsilon zeta. Eta theta iota."), (2, "tiny"), (3, ""), (4, None)], "doc_id long, text string")
    chunks = split(docs, "doc_id", "text").collect()
    assert {r.doc_id for r in chunks} == {1, 2} and [r.chunk_id for r in chunks if r.doc_id == 2] == ["2_fallback"]
    assert {r.doc_id for r in group(docs, "doc_id", "text").collect()} == {1}
    assert [c.name for c in registry.chosen("1", "text_splitter_char_naive")] == ["semantic_splitter_auto", "text_splitter_char_naive"]
