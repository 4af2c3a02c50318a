from tokenizers import Tokenizer

from chunklore.llm import tokencounts
from chunklore.llm.common import tokenizer_path
from chunklore.llm.queries import op2_digest_token_counts
from chunklore.llm.wordcache import WordCache

from . import cases


def plain(rows, name="byte_bpe_50k.json"):
    t = Tokenizer.from_file(tokenizer_path(name))
    return sorted(((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in rows), key=str)


def test_odd_rows_and_second_run(spark, tmp_path):
    docs = cases.frame(spark)
    cache = f"file://{tmp_path}/cache"
    want = plain([(r[0], r[1]) for r in cases.rows()])
    assert sorted(cases.collected(tokencounts.token_counts(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit"), key=str) == want
    version = tokencounts.version_of(tokenizer_path("byte_bpe_50k.json"))
    stored = spark.read.parquet(f"{cache}/{version}").count()
    assert stored == len({r[1] or "" for r in cases.rows()})
    more = docs.union(spark.createDataFrame([(99, "something new", *[None] * 6)], cases.SCHEMA))
    assert tokencounts.token_counts(more, cache).count() == len(want) + 1
    assert spark.read.parquet(f"{cache}/{version}").count() == stored + 1  # only the miss was encoded


def test_piece_model(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    found = tokencounts.token_counts(cases.frame(spark), f"file://{tmp_path}/c", "piece_bpe_32k.model")
    assert sorted(cases.collected(found, "doc_id", "n_tokens"), key=str) == sorted(((r[0], len(model.encode(r[1] or ""))) for r in cases.rows()), key=str)


def test_no_rows(spark, tmp_path):
    assert tokencounts.token_counts(cases.empty(spark), f"file://{tmp_path}/c").count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op2_digest_token_counts(spark, sf).collect()), key=str) == plain(docs)


def test_word_cache_is_exact():
    texts = ["", "  a b ", "a  b", "x <|endoftext|> y", "a\n b", "é é Σας ΣΑΣ", "tab\tx y", "I'm it's 'S x", "日本語 テスト 12 345", "a b\n\nc d ", "don't, \"x\" [a] (b)--c", "ﬁn Ǆ ǅx ŉ İstanbul K", "Ärger ñandú!! word,word", "́x a​b", "İ. फ़िल्म, ড়. ਸ਼ੇਰ; שּׁ! İstanbul'da", "क़लम. য়, ଡ଼) གྷ:"]
    for name, dropped in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        words = WordCache(tokenizer_path(name), dropped, keep=20)  # so small that it is emptied on the way
        for _ in range(2):
            assert words.ids(texts) == [words.whole(t) for t in texts]


def test_cuts_before_marks_for_every_character():
    """Parts whose last character the vocabulary's normal form takes apart are cut nowhere the library doesn't cut."""
    every = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and not c.isspace()]
    for name, dropped in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        words = WordCache(tokenizer_path(name), dropped)
        for form, step in (("a{}.", 1), ("{},", 7), ("x {}", 7)):
            some = every[::step] if step > 1 else every
            some = [*some, *(c for c in every if c.isalpha())] if step > 1 else some
            texts = ["q " + " ".join(form.format(c) for c in some[at : at + 512]) for at in range(0, len(some), 512)]
            assert words.ids(texts) == [words.whole(t) for t in texts], (name, form)
