"""The two operators that learn: gradients, accuracy on held-out rows, and odd rows."""

import zlib

import numpy as np

from chunklore.llm import langid, linecrf
from chunklore.llm.queries import op3_line_crf_quality, op5_bigru_language

from . import cases


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(3, 5, rng)
    x, y = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    there = np.ones((7, 4), np.float32)
    there[5:, 2] = 0
    _, grads = langid._gradients(net, x, y, there)
    for k, (a, g) in enumerate(zip(net.arrays, grads)):
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in a.shape)
            at = (at[0], at[1], int(x[rng.integers(7), rng.integers(4)])) if k == 0 else at
            old, step = a[at], 1e-2
            a[at] = old + step
            up = langid._gradients(net, x, y, there)[0]
            a[at] = old - step
            down = langid._gradients(net, x, y, there)[0]
            a[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_window_size_pools_all_bytes():
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(3, 4, rng)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 5, 16, 33)]
    many, one = langid.probabilities(net, texts, 16, 3), [langid.probabilities(net, [t], 16, 1)[0] for t in texts]
    assert np.allclose(many, one, atol=1e-5) and np.allclose(many.sum(1), 1, atol=1e-5)
    assert langid.probabilities(net, [b"", b"a"])[0].sum() == 0


def test_language_on_held_out_rows(spark, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = op5_bigru_language(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark):
    found = langid.predicted_languages(cases.frame(spark)).collect()
    assert len(found) == len(cases.rows())
    for r in found:
        if r.doc_id in (4, 5, 6, 15):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (0, 1, 2, 7):
            assert r.lang_pred in ("en", "fr") and r.score > 0
    assert langid.predicted_languages(cases.empty(spark)).count() == 0


def test_signs_and_digits_are_no_letters(spark):
    rows = [(i, f"some words {i}", "en") for i in range(20)] + [(100, "² ½ ①", "en"), (101, "123 _ ...", "en"), (102, "½ a", "en"), (103, "ª", "en"), (104, "́", None)]
    found = {r.doc_id: r.lang_pred for r in langid.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[i] for i in range(100, 105)] == ["und", "und", "en", "en", "und"]


def test_sample_reads_texts_to_their_ends(spark):
    text = "a" * 5000 + "b" * 5000 + "c" * 5000
    docs = spark.createDataFrame([(i, text, "en") for i in range(10)], "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, 100, 320, "doc_id", "text", "lang")
    assert sample and all(set(part) == {"a", "b", "c"} and len(part) == 320 for _, part in sample)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, f"the words of number {i} are here", "en" if zlib.crc32(str(i).encode()) % 5 else "xx") for i in range(60)]
    found = langid.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in found} == {"en"}


def test_field_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    field = linecrf.Field(np.zeros(1), rng.normal(size=(2, 2)))
    lengths = np.array([1, 3, 5])
    evidence = rng.normal(size=(5, 3)) * 2
    there = np.arange(5)[:, None] < lengths
    marginal, pairs, logz = field.marginals(evidence, there)
    for j, n in enumerate(lengths):
        weights = {y: np.exp(sum(evidence[t, j] * y[t] for t in range(n)) + sum(field.moves[y[t], y[t + 1]] for t in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        assert np.isclose(np.log(z), logz[j])
        for t in range(n):
            assert np.isclose(marginal[t, j], sum(w for y, w in weights.items() if y[t]) / z)
        for t in range(n - 1):
            assert np.isclose(pairs[t, 1, 0, j], sum(w for y, w in weights.items() if y[t] == 1 and y[t + 1] == 0) / z)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = op3_line_crf_quality(spark, d).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    found = linecrf.quality_scores(cases.frame(spark), labels).collect()
    assert len(found) == len(cases.rows()) and all(0 <= r.score <= 1 for r in found)
    none = linecrf.quality_scores(cases.frame(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert linecrf.quality_scores(cases.empty(spark), labels).count() == 0


def test_contradicting_labels_teach_nothing(spark):
    docs = cases.frame(spark)
    sample = lambda labels: sorted(linecrf.training_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 100, 6000, "doc_id", "text", "quality"))
    own = [(i, i % 2) for i in range(8)]
    assert sample([*own, (9, 0), (9, 1)]) == sample([(9, 1), *own, (9, 0)]) == sample(own)


def test_scores_do_not_depend_on_the_batch():
    texts = [cases.prose(i, 20 + i) + "\n" * (i % 7) + cases.prose(i + 1, 9) for i in range(30)] + ["", "\n" * 500]
    field = linecrf.train(texts, [i % 2 for i in range(len(texts))], rounds=20)
    assert np.allclose(linecrf.scores(field, texts, 4), [linecrf.scores(field, [t])[0] for t in texts])
