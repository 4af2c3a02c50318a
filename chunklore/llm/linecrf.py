"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is its own features and its neighbours'. The field is trained here on documents'
labels, each line taking its document's. A document's score is the mean of its lines' forward-backward marginals, weighted by
their lengths.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, importable, named
from .wordhash import UNBLANK, words


def _bytes(test) -> np.ndarray:
    return np.array([test(chr(b)) and b < 128 for b in range(256)])


#: Shares of a line's bytes that are features.
CLASSES = [_bytes(str.isupper), _bytes(str.islower), _bytes(str.isdigit), _bytes(lambda c: c in "#*$%&|<>"), _bytes(lambda c: c in "!?"), _bytes(lambda c: c in ".,;:"), _bytes(lambda c: c in "/\\=_@{}[]()+~^"), np.arange(256) >= 128]
#: Those, then share of words equal to the one before, to the one but one before, mean word length, log length, is blank, few words.
OWN = len(CLASSES) + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, 3 x OWN + 1) of a line and its neighbours, lengths in bytes, and lines of each text."""
    datas = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([1 + x.count(b"\n") for x in datas])
    blob = b"\n".join(datas) + b"\n"
    every = np.frombuffer(blob, np.uint8)
    end = np.flatnonzero(every == 10)
    first = np.concatenate([[0], end[:-1] + 1])
    size = end - first
    out = np.zeros((len(size), OWN), np.float32)
    for k, of in enumerate(CLASSES):
        sums = np.add.reduceat(of[every].astype(np.int32), first)
        out[:, k] = sums / np.maximum(size, 1)
    start, stop, h = words(blob, UNBLANK)
    own = np.searchsorted(first, start, "right") - 1
    n = np.bincount(own, minlength=len(size))
    for k, back in enumerate((1, 2)):
        same = (h[back:] == h[:-back]) & (own[back:] == own[:-back])
        out[:, len(CLASSES) + k] = np.bincount(own[back:][same], minlength=len(size)) / np.maximum(n, 1)
    out[:, -4] = np.minimum(np.bincount(own, stop - start, minlength=len(size)) / np.maximum(n, 1), 40) / 10
    out[:, -3] = np.log1p(size) / 6
    out[:, -2] = n == 0
    out[:, -1] = n < 3
    begin = np.cumsum(counts) - counts
    before, after = np.roll(out, 1, 0), np.roll(out, -1, 0)
    before[begin], after[begin + counts - 1] = 0, 0
    return np.concatenate([out, before, after, np.ones((len(size), 1), np.float32)], 1), size, counts


@dataclass
class Field:
    """weights: evidence for good; moves (2, 2): log potentials from a line's label to the next's; bad is 0, good 1."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, evidence: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """evidence (steps, texts): log odds of good. Marginals of good (steps, texts), of moves (steps - 1, 2, 2, texts), and log partition."""
        steps, n = evidence.shape
        a = np.exp(self.moves)
        good = np.exp(np.clip(evidence, -30, 30))
        forward, scale = np.empty((steps, 2, n)), np.empty((steps, n))
        state = np.stack([np.ones(n), good[0]])
        for t in range(steps):
            if t:
                state = np.einsum("in,ij->jn", state, a)
                state[1] *= good[t]
                state = np.where(there[t], state, forward[t - 1])
            scale[t] = np.where(there[t], state.sum(0), 1.0)
            state = state / state.sum(0)
            forward[t] = state
        back = np.ones((2, n))
        marginal, pairs = np.empty((steps, n)), np.zeros((max(0, steps - 1), 2, 2, n))
        for t in reversed(range(steps)):
            both = forward[t] * back
            marginal[t] = both[1] / both.sum(0)
            if t:
                e = np.stack([np.ones(n), good[t]]) * back
                pair = forward[t - 1][:, None] * a[:, :, None] * e[None]
                pairs[t - 1] = pair / pair.sum((0, 1)) * there[t]
                before = np.einsum("ij,jn->in", a, e)
                back = np.where(there[t], before / before.sum(0), back)
        return marginal, pairs, np.log(scale).sum(0)


def _padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, texts) of values that lie text by text, and where there are any."""
    steps = int(counts.max(initial=1))
    there = np.arange(steps)[:, None] < counts
    out = np.zeros((len(counts), steps))
    out[there.T] = values
    return out.T, there


def train(texts: list[str], y: list[int], rounds: int = 250, rate: float = 0.08, penalty: float = 1e-4) -> Field:
    """Fitted by Adam to the mean conditional log likelihood a line; the same for the same input."""
    x, size, counts = line_features(texts)
    label = np.repeat(np.array(y, float), counts)
    share = np.where(label == 1, (label == 0).mean(), (label == 1).mean()).clip(0.05)  # both labels count alike
    weight = share / share.sum()
    per_text = _padded(weight, counts)[0].sum(0) / counts
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    labels, there = _padded(label, counts)
    for step in range(1, rounds + 1):
        field = Field(params[:-4], params[-4:].reshape(2, 2))
        evidence, _ = _padded(x @ field.weights, counts)
        marginal, pairs, _ = field.marginals(evidence, there)
        own = ((labels - marginal) * per_text).T[there.T]
        seen = np.zeros((2, 2))
        moves = (there[1:] * per_text).sum(0)
        for k in (0, 1):
            seen[k, k] = moves[np.array(y) == k].sum()
        expected = (pairs * per_text).sum((0, 3))
        grad = np.concatenate([x.T @ own, (seen - expected).ravel()]) - penalty * params
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-4], params[-4:].reshape(2, 2))


def scores(field: Field, texts: list[str], group: int = 128) -> np.ndarray:
    """Length-weighted means of the lines' marginals of good, texts of like numbers of lines together."""
    x, size, counts = line_features(texts)
    evidence = x @ field.weights
    begin = np.cumsum(counts) - counts
    out = np.zeros(len(texts))
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + group]
        if counts[some[-1]] > 4 * counts[some[0]] + 64:
            some = some[counts[some] <= 4 * counts[some[0]] + 64]
        rows = np.concatenate([np.arange(begin[i], begin[i] + counts[i]) for i in some])
        e, there = _padded(evidence[rows], counts[some])
        weight, _ = _padded(size[rows] + 1.0, counts[some])
        marginal = field.marginals(e, there)[0]
        out[some] = (marginal * weight).sum(0) / weight.sum(0)
        at += len(some)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, most: int, most_chars: int, id_col: str, text_col: str, label_col: str) -> list[tuple[int, str]]:
    """(label, run of lines of the text, from a place by the hash of the id) of at most ``most`` labelled rows that aren't held out, by the hash of their id."""
    own = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")  # none where labels contradict each other
    own = own.withColumn("mark", F.xxhash64("doc_id")).orderBy("mark", "doc_id").limit(most)
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    from_ = F.pmod(F.xxhash64(named(id_col).cast("long"), F.lit("run")), F.greatest(F.length(text) - most_chars + 1, F.lit(1)).cast("long")).cast("int")
    run = F.substr(text, from_ + 1, F.lit(most_chars))
    whole = F.when(from_ > 0, F.regexp_replace(run, r"\A[^\n]*\n(?=[\s\S])", "")).otherwise(run)  # from a line's start, where there is another
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), whole.alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").orderBy("mark", "doc_id", "text").limit(2 * most).collect()  # the broadcast has ``most`` rows of three numbers
    return [(r.y, r.text) for r in rows]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 3000, most_chars: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Learned from at most ``most`` labelled rows that aren't held out, of each a run of lines of ``most_chars`` characters at most from anywhere in it; scored on whole texts. Null
    text counts as empty: one blank line. Where there is nothing to learn from every score is 0.5. A document whose labels contradict each other teaches nothing. Null ids are never held out and
    learn nothing; repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    sample = training_sample(docs, labels, most, most_chars, id_col, text_col, label_col)
    field = train([t for _, t in sample], [y for y, _ in sample]) if sample else Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)))
    shared = spark.sparkContext.broadcast(field)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [scores(shared.value, texts.iloc[at : at + 512].tolist()) for at in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts])).clip(0, 1)

    scored = F.pandas_udf(score, "double")
    out = docs.select(named(id_col).alias("doc_id"), scored(F.coalesce(named(text_col).cast("string"), F.lit(""))).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
