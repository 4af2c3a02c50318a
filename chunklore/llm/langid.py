"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes from both ends, gives every position a distribution over the languages, and a document's
probabilities are the means over all its positions. It is trained here, in numpy, by backpropagation through time.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, importable, named

UNDETERMINED = "und"
#: Windows of a sampled text, from its first character to its last.
WINDOWS = 5


def has_letter(text: str) -> bool:
    """Of the Unicode categories L: number signs and digits are none."""
    return any(map(str.isalpha, text))


@dataclass
class Network:
    """Two directions side by side: byte tables e (2, 3h, 256), recurrent u (2, 3h, h), its bias b (2, h, 1), output o (2, k, h), its bias c (k, 1). Of the 3h the first h are
    the update gate's, then the reset gate's, then the candidate's; gates are taken as tanh of their half."""

    e: np.ndarray
    u: np.ndarray
    b: np.ndarray
    o: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, k: int, h: int, rng: np.random.Generator) -> "Network":
        f = np.float32
        return cls(rng.normal(0, 0.3, (2, 3 * h, 256)).astype(f), rng.normal(0, h**-0.5, (2, 3 * h, h)).astype(f), np.zeros((2, h, 1), f), rng.normal(0, 0.3, (2, k, h)).astype(f), np.zeros((k, 1), f))

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.u, self.b, self.o, self.c]


def _forward(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: bytes (steps, windows). Logits (steps, k, windows); with keep what each step needs for its gradient."""
    steps, n = x.shape
    h = net.u.shape[2]
    logits = np.empty((steps, net.c.shape[0], n), np.float32)
    logits[:] = net.c
    state, kept = np.zeros((2, h, n), np.float32), []
    given, own = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    gates = np.empty((2, 2 * h, n), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        np.take(net.e[0], x[t], axis=1, out=given[0], mode="clip")
        np.take(net.e[1], x[back], axis=1, out=given[1], mode="clip")
        np.matmul(net.u, state, out=own)
        np.add(given[:, : 2 * h], own[:, : 2 * h], out=gates)
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:, :h], gates[:, h:]
        inner = own[:, 2 * h :]
        inner += net.b
        candidate = r * inner
        candidate += given[:, 2 * h :]
        np.tanh(candidate, out=candidate)
        new = state - candidate
        new *= z
        new += candidate
        if keep:
            kept.append((state, z.copy(), r.copy(), inner.copy(), candidate, new))
        state = new
        said = net.o @ state
        logits[t] += said[0]
        logits[back] += said[1]
    return logits, kept


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(1, keepdims=True))
    logits /= logits.sum(1, keepdims=True)
    return logits


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of the mean cross-entropy over positions that are there; y: a language for each window."""
    steps, n = x.shape
    h, k = net.u.shape[2], net.c.shape[0]
    logits, kept = _forward(net, x, keep=True)
    p = _softmax(logits)
    weight = there / there.sum()
    picked = np.take_along_axis(p, np.broadcast_to(y, (steps, 1, n)), 1)[:, 0]
    loss = float(-(np.log(picked + 1e-9) * weight).sum())
    np.put_along_axis(p, np.broadcast_to(y, (steps, 1, n)), picked[:, None] - 1, 1)
    p *= weight[:, None]
    de, du, db, do = (np.zeros_like(a) for a in net.arrays[:4])
    dstate = np.zeros((2, h, n), np.float32)
    dgiven = np.empty((steps, 2, 3 * h, n), np.float32)
    for t in reversed(range(steps)):
        state, z, r, inner, candidate, new = kept[t]
        dout = np.stack([p[t], p[steps - 1 - t]])
        do += dout @ new.transpose(0, 2, 1)
        dstate += net.o.transpose(0, 2, 1) @ dout
        dc = dstate * (1 - z) * (1 - candidate * candidate)
        dz = dstate * (state - candidate) * z * (1 - z)
        dr = dc * inner * r * (1 - r)
        dinner = dc * r
        downer = np.concatenate([dz, dr, dinner], 1)
        dgiven[t] = np.concatenate([dz, dr, dc], 1)
        du += downer @ state.transpose(0, 2, 1)
        db += dinner.sum(2, keepdims=True)
        dstate = dstate * z + net.u.transpose(0, 2, 1) @ downer
    for d, seen in ((0, x), (1, x[::-1])):
        flat = seen.ravel()
        for row in range(3 * h):
            de[d, row] = np.bincount(flat, dgiven[:, d, row].ravel(), 256)
    return loss, [de, du, db, do, p.sum((0, 2))[:, None].astype(np.float32)]


def train(texts: list[bytes], y: list[int], k: int, hidden: int = 16, steps: int = 320, batch: int = 128, width: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """A network fitted by Adam to random windows of the texts; the same for the same input."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(k, hidden, rng)
    first, second = [np.zeros_like(a) for a in net.arrays], [np.zeros_like(a) for a in net.arrays]
    labels = np.array(y)
    share = 1 / np.bincount(labels, minlength=k).clip(1)[labels]  # every language as often
    share /= share.sum()
    for step in range(1, steps + 1):
        x, there = np.full((width, batch), 32, np.uint8), np.zeros((width, batch), np.float32)
        own = rng.choice(len(texts), batch, p=share)
        for j, i in enumerate(own):
            at = int(rng.integers(0, max(1, len(texts[i]) - width + 1)))
            part = np.frombuffer(texts[i], np.uint8)[at : at + width]
            x[: len(part), j] = part
            there[: len(part), j] = 1
        _, grads = _gradients(net, x, labels[own], there)
        now = rate * (1 - step / (steps + 1))
        for a, g, m, v in zip(net.arrays, grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, texts: list[bytes], width: int = 128, windows: int = 1024) -> np.ndarray:
    """(texts, k): each text's mean over all its bytes; zeros for empty ones."""
    sizes = np.array([len(t) for t in texts])
    total = np.zeros((len(texts), net.c.shape[0]))
    each = -(-sizes // width)
    owner = np.repeat(np.arange(len(texts)), each)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * width
    for at in range(0, len(owner), windows):
        own, begin = owner[at : at + windows], start[at : at + windows]
        x = np.full((len(own), width), 32, np.uint8)
        length = np.minimum(sizes[own] - begin, width)
        for j, (i, s, n) in enumerate(zip(own, begin, length, strict=True)):
            x[j, :n] = np.frombuffer(texts[i], np.uint8, n, s)
        p = _softmax(_forward(net, np.ascontiguousarray(x.T))[0])
        if (length < width).any():
            p *= (np.arange(width)[:, None] < length)[:, None, :]
        np.add.at(total, own, p.sum(0).T)
    return total / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, per_language: int, excerpt: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(lang, windows from the text's beginning to its end, ``excerpt`` characters in all) of about ``per_language`` documents of each language that aren't held out, by the hash of their id: a sample whose
    size doesn't grow with the corpus."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    mark = F.xxhash64("doc_id", "text")
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(mark, F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.element_at(rates, F.col("lang"))
    each = excerpt // WINDOWS
    spread = [F.substr("text", (1 + F.floor(i * (F.length("text") - each) / (WINDOWS - 1))).cast("int"), F.lit(each)) for i in range(WINDOWS)]
    part = F.when(F.length("text") <= excerpt, F.col("text")).otherwise(F.concat(*spread))
    took = rows.filter(place).select("lang", part.alias("part"), mark.alias("mark")).orderBy("mark", "lang", "part").limit(2 * per_language * len(counts))
    return [(r.lang, r.part) for r in took.collect()]


def language_predictor(docs: DataFrame, per_language: int = 600, excerpt: int = 320, hidden: int = 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """A function from a text column to struct<lang_pred, score>, learned from the rows of ``docs`` that aren't held out and have a language.

    ``und`` with score 0 where a text is null or has no letters, or where there was nothing to learn from. Of languages equally likely the first by name
    counts. Very long texts are read in groups of windows of 128 bytes, each on its own. The sample is bound by per_language and excerpt; ids, sources and languages are no input of a prediction.
    """
    spark = docs.sparkSession
    importable(spark)
    sample = training_sample(docs, per_language, excerpt, id_col, text_col, lang_col)
    langs = sorted({lang for lang, _ in sample})
    sample = [(lang, part) for lang, part in sample if has_letter(part)]
    net = train([p.encode() for _, p in sample], [langs.index(lang) for lang, _ in sample], len(langs), hidden) if sample else None
    shared = spark.sparkContext.broadcast((langs, net))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, net = shared.value
        for texts in batches:
            lang, score = [], []
            for at in range(0, len(texts), 512):
                some = texts.iloc[at : at + 512].tolist()
                known = [bool(t and net is not None and has_letter(t)) for t in some]
                p = probabilities(net, [t.encode("utf-8", "surrogatepass") for t, k in zip(some, known, strict=True) if k]) if any(known) else None
                best = iter(zip(p.argmax(1), p.max(1), strict=True)) if p is not None else iter(())
                for k in known:
                    i, s = next(best) if k else (0, 0.0)
                    lang.append(langs[i] if k else UNDETERMINED)
                    score.append(min(1.0, float(s)))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(predict, "lang_pred string, score double")


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows may repeat, ids be null, other columns are ignored; an empty table gives no rows."""
    predict = language_predictor(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    out = docs.select(named(id_col).alias("doc_id"), predict(named(text_col).cast("string")).alias("p"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "p.lang_pred", "p.score")
