"""Quality rules on how public vocabularies take a text: characters per token, byte-fallback share, token entropy.

The tokens of a text are those of its words, each after a blank, so white space doesn't count; strings of special tokens are ordinary text. A character that the piece vocabulary
lacks when it stands alone is taken as its bytes wherever it stands; the fallback share is that of such bytes among the words' bytes. Every script has its band; a text
outside it is rejected. Within the bands the corpus itself sets each script's least characters a token and most tokens a word, by
its quartiles. Base rules on words and their repeats come first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, tokenizer_path, with_text, written
from .wordhash import UNBLANK, shingles, words

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"
)
BLANKS = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")
NO_LETTERS = bytes(b for b in range(256) if b >= 128 or not chr(b).isalpha())
SYMBOL = np.array([b in b"#*$%&|<>" for b in range(256)])


@dataclass(frozen=True)
class Band:
    """What a script's texts are kept within. The entropy floor, in bits, is the smaller of ``entropy`` and ``even`` x log2(tokens): short texts can't have more."""

    least_chars: float
    most_chars: float
    most_fallback: float
    entropy: float = 5.0
    even: float = 0.7


#: Wide, by script: subword vocabularies of mostly Latin text take other scripts in smaller parts.
BANDS = {
    "latin": Band(1.2, 8.0, 0.10),
    "greek": Band(0.4, 5.0, 0.50),
    "cyrillic": Band(0.4, 5.0, 0.50),
    "cjk": Band(0.2, 3.0, 0.80),
    "other": Band(0.1, 8.0, 1.00),
    "none": Band(0.1, 8.0, 0.50),
}
#: East Asian scripts that words aren't parted in, by how Unicode names their letters.
CJK = {"cjk", "hiragana", "katakana", "katakana-hiragana", "hangul", "bopomofo", "yi"}
_OUTSIDE = re.compile(r"[^\x00-\x7f]+")
_scripts: dict[str, str | None] = {}  # by character; Unicode bounds it


def script_of_letter(c: str) -> str | None:
    """The first word of a letter's Unicode name, in lower case, CJK put together; None for what is no letter."""
    if c not in _scripts:
        name = unicodedata.name(c, "other").split()[0].lower() if c.isalpha() else None
        _scripts[c] = "cjk" if name in CJK else name
    return _scripts[c]


def script_of(text: str) -> str:
    """The script that most letters have, of equals the first by name; ``none`` without letters."""
    counts: Counter = Counter()
    if not text.isascii():
        for c, n in Counter("".join(_OUTSIDE.findall(text))).items():
            if script := script_of_letter(c):
                counts[script] += n
    if plain := len(text.encode("utf-8", "surrogatepass").translate(None, NO_LETTERS)):
        counts["latin"] += plain
    return min(counts, key=lambda x: (-counts[x], x)) if counts else "none"


def repeat_words(found: list[bytes], n: int = 5) -> int:
    """Words in windows of n words that the text has twice or more."""
    windows = list(zip(*(found[i:] for i in range(n)), strict=False))
    counts = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + n - max(i, upto)
            upto = i + n
    return total


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if line.strip(" \t\n\v\f\r"))


class Fertility:
    """The two vocabularies, for one worker."""

    def __init__(self, byte_path: str, piece_path: str, keep: int = 500_000):
        import sentencepiece

        from .wordcache import WordCache

        self.ids = WordCache(byte_path, False, keep, ordinary=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.single = {i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i) or self.pieces.is_unknown(i)}
        self.fallback: dict[str, int] = {}  # by character; Unicode bounds it

    def fallback_bytes(self, text: str) -> int:
        """Bytes of characters that the piece vocabulary takes byte by byte."""
        there = set(text)
        for c in [c for c in there if c not in self.fallback]:
            alone = not c.isspace() and any(i in self.single for i in self.pieces.encode(c))
            self.fallback[c] = len(c.encode("utf-8", "surrogatepass")) if alone else 0
        return sum(self.fallback[c] * text.count(c) for c in there if self.fallback[c])

    def measures(self, text: str, n_bytes: int, word_chars: int) -> tuple[int, float, float, float]:
        """n_tokens, chars_per_token, fallback_share, token_entropy. n_bytes: of the words."""
        parts = [" " + w for w in text.translate(BLANKS).split(" ") if w]
        if not parts:
            return 0, 0.0, 0.0, 0.0
        tokens = np.frombuffer(b"".join([self.ids.whole(p) if x is None else x for p, x in zip(parts, self.ids.found(parts), strict=True)]), "<u4")
        counts = np.diff(np.flatnonzero(np.diff(np.sort(tokens), prepend=-1, append=1 << 33)))
        share = counts / len(tokens)
        return len(tokens), word_chars / len(tokens), self.fallback_bytes(text) / n_bytes, float(-(share * np.log2(share)).sum())


def judged(script: str, n_tokens: int, chars_per_token: float, fallback_share: float, token_entropy: float, bands: dict[str, Band]) -> bool:
    band = bands.get(script, bands["other"])
    floor = min(band.entropy, band.even * math.log2(max(1, n_tokens)))
    return band.least_chars <= chars_per_token <= band.most_chars and fallback_share <= band.most_fallback and token_entropy >= floor


#: A script's quartiles count from so many texts on that pass the base rules; with fewer its band alone does.
LEAST_TEXTS = 100


def fitted(measured: DataFrame) -> DataFrame:
    """Rows of SCHEMA, kept only within their script's fences too: a quartile and 1.5 times the distance of the quartiles, or a quarter of it if that is more.
    A mean over few words strays further: ten words have twice that room, and the more the less.

    Values are rounded and capped, so that exact quartiles need few of them however many rows there are.
    """
    measures = {"chars": F.round(F.least("chars_per_token", F.lit(100.0)), 2), "tokens": F.round(F.least(F.col("n_tokens") / F.greatest("n_words", F.lit(1)), F.lit(100.0)), 2)}
    passed = measured.filter("NOT base_failed").select(F.col("script").alias("of"), *[v.alias(k) for k, v in measures.items()])
    found = passed.groupBy("of").agg(F.count("*").alias("n"), *[F.percentile(k, [0.25, 0.75]).alias(k) for k in measures]).filter(F.col("n") >= LEAST_TEXTS)
    low, high = (lambda k: F.col(k)[0]), (lambda k: F.col(k)[1])
    room = F.greatest(1.5 * (high("chars") - low("chars")), 0.25 * low("chars")), F.greatest(1.5 * (high("tokens") - low("tokens")), 0.25 * high("tokens"))
    fences = F.broadcast(found.select("of", low("chars").alias("low"), high("tokens").alias("high"), room[0].alias("below"), room[1].alias("above")))  # a row a script
    wider = 1 + F.sqrt(10 / F.greatest("n_words", F.lit(1)))
    within = F.coalesce((measures["chars"] >= F.col("low") - F.col("below") * wider) & (measures["tokens"] <= F.col("high") + F.col("above") * wider), F.lit(True))
    own = measured.columns
    return measured.join(fences, F.col("script") == F.col("of"), "left").select(*[(F.col("kept") & within).alias("kept") if c == "kept" else c for c in own])


def fertility_rules(docs: DataFrame, byte_vocabulary: str = "byte_bpe_50k.json", piece_vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base measures, base_failed, kept, and what the vocabularies measured (columns of SCHEMA).

    A word ends at the blanks 20 and 09 to 0D. base_failed: fewer than 10 words, or over a fifth of the words in repeated five-word windows. Null and
    empty texts have no words and fail. Ids may be null, rows may repeat, other columns are ignored, an empty table gives no rows.
    """
    importable(docs.sparkSession)
    bands = bands or BANDS

    def measure(batches):
        vocabularies = _worker(tokenizer_path(byte_vocabulary), tokenizer_path(piece_vocabulary))  # where this worker has them
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict(rows(vocabularies, part.column("doc_id"), part.column("text").to_pylist(), bands), schema=ARROW)

    return fitted(written(with_text(docs, id_col, text_col).mapInArrow(measure, SCHEMA), "fertility"))


ARROW = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
_workers: dict[tuple[str, str], Fertility] = {}


def _worker(*paths: str) -> Fertility:
    if paths not in _workers:
        _workers[paths] = Fertility(*paths)
    return _workers[paths]


def rows(vocabularies: Fertility, ids, texts: list[str], bands: dict[str, Band]) -> dict:
    datas = [t.encode("utf-8", "surrogatepass") for t in texts]
    blob = b"\n".join(datas) + b"\n"
    every = np.frombuffer(blob, np.uint8)
    size = np.array([len(x) + 1 for x in datas])
    first = np.cumsum(size) - size
    start, _, h = words(blob, UNBLANK)
    own = np.searchsorted(first, start, "right") - 1  # each word's text
    n_words = np.bincount(own, minlength=len(texts))
    n_bytes = np.add.reduceat(UNBLANK[every].astype(np.int64), first)
    word_chars = np.add.reduceat((UNBLANK[every] & ((every & 0xC0) != 0x80)).astype(np.int64), first)
    n_symbols = np.add.reduceat(SYMBOL[every].astype(np.int64), first)
    windows = shingles(h, 5)
    inside = own[: len(windows)] == own[4:] if len(windows) else np.zeros(0, bool)
    keys = np.stack([own[: len(windows)][inside].astype(np.uint64), windows[inside]])
    keys = keys[:, np.lexsort(keys[::-1])]
    again = np.unique(keys[0, 1:][(keys[:, 1:] == keys[:, :-1]).all(0)]).astype(int)  # texts where a window may come twice
    repeated = dict.fromkeys(again.tolist())
    out: dict[str, list] = {name: [] for name in ARROW.names}
    for i, (text, data) in enumerate(zip(texts, datas, strict=True)):
        n, repeats = int(n_words[i]), repeat_words(data.split()) if i in repeated else 0
        script, measured = script_of(text), vocabularies.measures(text, int(n_bytes[i]), int(word_chars[i]))
        failed = n < 10 or 100 * repeats > 20 * n
        row = (None, n, int(word_chars[i]), int(n_symbols[i]), dup_lines(text), repeats, failed, not failed and judged(script, *measured, bands), script, *measured)
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return out | {"doc_id": ids.cast(pa.int64())}
