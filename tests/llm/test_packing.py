import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklore.llm import packing
from chunklore.llm.common import tokenizer_path
from chunklore.llm.queries import op1_pattern_packing

from . import cases


def placed(plan, histogram):
    """Every piece that the plan holds, as sequence -> [(offset, length)]."""
    out, count = {}, Counter()
    for length, k, each, first, sequences, offset in sorted(plan.entries):
        assert k == count[length]
        for s in range(sequences):
            out.setdefault(first + s, []).extend((offset + i * length, length) for i in range(each))
        count[length] += each * sequences
    assert count == Counter(histogram)
    return out


def whole(sequences, seq_len):
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= seq_len


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 60), max_size=40))
def test_plan_places_everything_once(histogram):
    plan = packing.plan(histogram, 256, bins=32)
    sequences = placed(plan, histogram)
    whole(sequences, 256)
    assert set(sequences) == set(range(plan.sequences))


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    histogram = Counter(np.clip(rng.lognormal(6.2, 1, 20_000).astype(int), 1, 4096).tolist())
    plan = packing.plan(histogram, 4096)
    assert plan.sequences <= 1.01 * -(-sum(k * n for k, n in histogram.items()) // 4096) + 1


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, y = rng.random((12, 30)), rng.random(12) * 5
    x = packing.nnls(a, y)
    gradient = a.T @ (a @ x - y)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_patterns_fill_and_are_distinct():
    found = packing.patterns(16, 3)
    assert all(sum(p) == 16 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in found)
    assert len(found) == len(set(found)) == sum(1 for a in range(1, 16) for b in range(a + 1) for c in range(b + 1) if a + b + c == 16)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def expected(rows, tokenizer, seq_len):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), seq_len)):
            part = ids[at : at + seq_len]
            out.append((doc_id, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return Counter(out)


def test_odd_rows(spark, tokenizer):
    docs = cases.frame(spark)
    pieces = packing.tokenized_pieces(docs, seq_len=128)
    found = packing.packed(pieces, seq_len=128, bins=32).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in found) == expected([(r[0], r[1]) for r in cases.rows()], tokenizer, 128)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    whole(sequences, 128)


def test_texts_of_many_scripts(spark, tokenizer):
    rows = [(1, "İstanbul'da İ. güzel, İ!"), (2, "फ़िल्म. क़लम, ज़रूर! " * 20), (3, "বাংলা য়, ড়. ঢ়; " * 20), (4, "שּׁ. אּ, שלום!"), (5, "ਸ਼ੇਰ. ਖ਼ਬਰ, ਗ਼"), (6, "Ὀδυσσεύς, Ⅷ. ǅ!")]
    pieces = packing.tokenized_pieces(spark.createDataFrame(rows, "doc_id long, text string"), seq_len=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in pieces) == expected(rows, tokenizer, 64)


def test_no_rows(spark):
    assert packing.packed(packing.tokenized_pieces(cases.empty(spark))).count() == 0


def test_query(spark, sf, tokenizer):
    found = op1_pattern_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected(docs, tokenizer, 4096)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    whole(sequences, 4096)
    assert len(sequences) <= -(-sum(r.length for r in found) // 4096) + 1
