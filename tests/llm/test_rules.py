"""Tokenizer fertility and URL rules."""

import math
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklore.llm import fertility, urlfilter
from chunklore.llm.common import tokenizer_path
from chunklore.llm.queries import URL_RULES, op7_tokenizer_fertility

from . import cases

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\t#é\x1c", max_size=60), min_size=1, max_size=6))
def test_base_measures(texts):
    tools = fertility._worker(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    found = fertility.rows(tools, pa.array(range(len(texts))), texts, fertility.BANDS)
    for i, t in enumerate(texts):
        want = plain(t)
        assert tuple(found[k][i] for k in BASE) == want
        assert found["base_failed"][i] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (found["base_failed"][i] and found["kept"][i])


def test_odd_rows(spark):
    found = fertility.fertility_rules(cases.frame(spark)).collect()
    assert Counter((r.doc_id, *(r[k] for k in BASE)) for r in found) == Counter((r[0], *plain(r[1])) for r in cases.rows())
    assert fertility.fertility_rules(cases.empty(spark)).count() == 0


def test_bands():
    assert fertility.judged("latin", 100, 3.0, 0.0, 6.0, fertility.BANDS)
    assert not fertility.judged("latin", 100, 0.5, 0.0, 6.0, fertility.BANDS)
    assert not fertility.judged("latin", 100, 3.0, 0.5, 6.0, fertility.BANDS)
    assert not fertility.judged("latin", 1000, 3.0, 0.0, 2.0, fertility.BANDS)


def test_scripts():
    told = {"привет": "cyrillic", "日本語 テスト": "cjk", "12 !": "none", "“—…” 👍 ¼": "none", "Tiếng Việt ế": "latin", "हिन्दी": "devanagari", "שלום": "hebrew", "αβγ": "greek", "ab αβ": "greek", "": "none", "한국어": "cjk"}
    assert {t: fertility.script_of(t) for t in told} == told


def plain_measures(text, tokenizer, model):
    """What the libraries say word by word and character by character."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for x in w for i in tokenizer.encode(" " + x, add_special_tokens=False).ids]
    if not ids:
        return 0, 0.0, 0.0, 0.0
    alone = lambda c: any(model.is_byte(i) or model.is_unknown(i) for i in model.encode(c))
    bytes_ = sum(len(c.encode()) for x in w for c in x)
    share = [n / len(ids) for n in Counter(ids).values()]
    return len(ids), sum(map(len, w)) / len(ids), sum(len(c.encode()) for x in w for c in x if not c.isspace() and alone(c)) / bytes_, -sum(x * math.log2(x) for x in share)


def test_measured_columns_and_verdict(spark, sf):
    import numpy as np
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer, model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    tokenizer.encode_special_tokens = True
    odd = [(-1, "日本語 テスト " * 9), (-2, "İstanbul’da “x” — 👍🏽 हिन्दी. " * 4), (-3, None), (-4, "plain words and 12 345 marks!? " * 3), (-5, "x <|endoftext|> y " * 6)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    found = {r.doc_id: r for r in fertility.fertility_rules(docs).collect()}
    values = {}
    for r in docs.collect():
        got, want = found[r.doc_id], plain_measures(r.text or "", tokenizer, model)
        assert (got.n_tokens, got.script) == (want[0], fertility.script_of(r.text or ""))
        assert np.allclose((got.chars_per_token, got.fallback_share, got.token_entropy), want[1:])
        values[r.doc_id] = (round(min(want[1], 100) + 1e-12, 2), round(min(want[0] / max(1, got.n_words), 100) + 1e-12, 2))
    for script in {r.script for r in found.values()}:
        own = [d for d, r in found.items() if r.script == script and not r.base_failed]
        (low, high_), (low_, high) = (np.percentile([values[d][k] for d in own], [25, 75]) if own else (0, 0) for k in (0, 1))
        for d in own:
            r, wide = found[d], 1 + math.sqrt(10 / found[d].n_words)
            fences = values[d][0] >= low - max(1.5 * (high_ - low), 0.25 * low) * wide - 0.02 and values[d][1] <= high + max(1.5 * (high - low_), 0.25 * high) * wide + 0.02
            band = fertility.judged(script, r.n_tokens, r.chars_per_token, r.fallback_share, r.token_entropy, fertility.BANDS)
            assert not r.kept or (band and (fences or len(own) < fertility.LEAST_TEXTS))
            assert r.kept or not band or len(own) >= fertility.LEAST_TEXTS


def test_fallback_bytes():
    tools = fertility._worker(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert tools.fallback_bytes("plain text, é ß") == 0
    assert tools.fallback_bytes("\U00013000\U00013000 a") == 8


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = op7_tokenizer_fertility(spark, d).collect()
    assert not [r for r in found if truth.get(r.doc_id) == 1 and not r.base_failed and not r.kept]


def plain_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (*f[:2], f[3] == "block"), default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/de/", "http://x.com/fr", "http://com/fr/a", "ftp://notexample.org/es/", "no scheme", None, "", "://", "http://", "http://h?x=://y", "http://example.org#f", "a://b://c/d", "http://Éxample.com/de/é", "http://example.org/en/1", "http://x.com:80/fr/", "http://.com/de/"] * 2
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[0], "x", "y")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = urlfilter.url_verdicts(pages, rules)
    want = [(i, *plain_url(u, URL_RULES)) for i, u in enumerate(urls)] + [(None, *plain_url(urls[0], URL_RULES))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    more = [("org", "", "block"), ("example.org", "/es", "allow"), ("example.org", "/es", "block"), ("b://c", "/", "block")]
    found = urlfilter.url_verdicts(pages, spark.createDataFrame(more, "host string, path string, verdict string"), default="block")
    assert sorted((r.verdict, str(r.page_id)) for r in found.collect()) == sorted((plain_url(u, more, "block")[3], str(i)) for i, u in [*enumerate(urls), (None, urls[0])])
    assert {r.verdict for r in urlfilter.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlfilter.url_verdicts(pages.limit(0), rules).count() == 0
