"""Functions and readers on hand-written cases, against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunklore import schemas
from chunklore.functions import cleaning, labels, text, triples
from chunklore.operators import chunking, embedding, integrate, pairs
from chunklore.operators.signals import hashed_vectors
from chunklore.sources import readers, writers
from chunklore.streaming import chunks as streaming

TEXTS = ["", "   ", "One.", "No mark at all", "Short. A sentence that is long enough. Élan follows here! lower case follows. Next one? Yes", "This document has no information.", "a\tb\r\nc  d", "Tab nbsp. Word!  Two blanks.", "x" * 30 + "; and more; " + "y" * 20]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_splitters(spark):
    t = F.col("text")
    collapse = lambda x: re.sub(r"\s+", " ", x)
    full = lambda parts: [p.strip() for p in parts if p.strip()]
    ended = lambda p: p if re.search(r"[.!?]$", p) else p + "."
    assert column(spark, TEXTS, text.sentences_profile(t)) == [full(re.split(r"(?<=[.!?])\s+", collapse(x))) for x in TEXTS]
    assert column(spark, TEXTS, text.sentences_chunk_profile(t)) == [full(re.split(r"(?<=[.!?！？。])\s+", x)) for x in TEXTS]
    strict = [[ended(p) for p in full(re.split(r"(?<=[.!?])\s+(?=[A-Z])", collapse(x).strip())) if len(p) >= 10] for x in TEXTS]
    assert column(spark, TEXTS, text.sentences_strict(t)) == strict
    assert column(spark, TEXTS, text.sentences_plain(t)) == [full(re.split(r"(?<=[.!?])\s+(?=[A-Z])", x)) for x in TEXTS]


def test_long_sentences_and_simplified(spark):
    long = "; ".join(f"part {i} of a sentence that goes on" for i in range(60)) + "."
    assert all(len(s) < 60 for s in column(spark, [long], text.sentences_bounded(F.col("text")))[0])
    rows = ["We went to the market, and they stayed at home.; Next part here", "Short, and short."]
    assert column(spark, rows, text.simplified(F.array("text"))) == [["We went to the market.", "they stayed at home.", "Next part here"], ["Short, and short."]]


def test_words_and_tokens(spark):
    values = ["Élan vital, déjà-vu! x_1", "", "  a  b "]
    assert column(spark, values, text.words(F.col("text"))) == [v.split() for v in values]
    assert column(spark, values, text.word_tokens(F.col("text"))) == [re.findall(r"\w+", v.lower()) for v in values]
    assert column(spark, values, text.token_count(F.col("text"))) == [len(re.findall(r"\b\w+\b|[^\w\s]", v)) for v in values]


def test_labels(spark):
    values = ["1", " 1.9 ", "-0.5", "nan", "inf", "", "yes", "-1", "Relevant", "x", None, "1e400", "99999999999"]
    assert column(spark, values, labels.numeric_label(F.col("text"))) == [1, 1, 0, None, None, None, None, -1, None, None, None, None, None]
    assert column(spark, values, labels.mapped_label(F.col("text"))) == [1, 1, 0, None, None, None, 1, 0, 1, None, None, None, None]


def plain_chunks(x, size, overlap):
    if size <= 0:
        return [x] if x else []
    step = size - max(0, min(overlap, size - 1))
    out, at = [], 0
    while x:
        out.append(x[at : at + size])
        if at + size >= len(x):
            break
        at += step
    return out


@pytest.mark.parametrize(("size", "overlap"), [(7, 0), (7, 3), (7, 6), (7, 7), (7, 50), (7, -2), (1, 0), (0, 0), (600, 50)])
def test_fixed_chunks(spark, size, overlap):
    values = ["", "a", "abcdefg", "abcdef", "abcdefgh", "é" * 14, "x" * 700, "日本語" * 9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")
    found = chunking.chunked(rows, chunking.fixed_width(F.col("text"), F.col("doc_id"), size, overlap), "doc_id").collect()
    for i, v in enumerate(values):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [r.chunk_text for r in own] == plain_chunks(v, size, overlap)
        assert all(r.chunk_id == f"{i}_chunk{r.chunk_index}" and v[r.start : r.end] == r.chunk_text for r in own)


def test_written_form(spark):
    rows = spark.createDataFrame([("\t a\nb ",), (" \n",), ("z" * 50_010,)], "chunk_text string")
    assert sorted((len(r[0]), r[0][:3], r[0][-3:]) for r in chunking.written_form(rows).collect()) == [(3, "a b", "a b"), (50_003, "zzz", "...")]


def test_cleaning(spark):
    given_ = [
        "Language: Spanish Article Type:BFN [Text] The [parliament] met [passage omitted] today.",
        "He joined the ANC. The talks went on. It is the. End of in. Peace..",
        "SANTIAGO -- The minister said so. -- And so it was -- indeed.",
        "conclusion: 1) first; 2) second ,  he said .Next",
        None,
    ]
    got = column(spark, given_, cleaning.corpus_clean(F.col("text")))
    assert got[0] == "The (parliament) met today."
    assert got[1] == "He joined the ANC. The talks went on. It is the End of in Peace."
    assert got[2] == "SANTIAGO: The minister said so. And so it was, indeed."
    assert got[3] == "conclusion first second , he said. Next"
    assert got[4] == ""
    def apply(x, rules):
        for pattern, to in rules:
            x = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), x)
        return x

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + given_[:4]
    for x, y in zip(docs, column(spark, docs, cleaning.corpus_clean(F.col("text")))):
        z = apply(x, cleaning.HEADERS + cleaning.TAGS + cleaning.TRANSCRIPT + cleaning.BRACKETS)
        for a in cleaning.ACRONYMS:
            z = re.sub(rf"\b{a}\.(\s+[A-Za-z]|$)", lambda m, a=a: a + "@@" + (" " + m[1].strip() if m[1] else ""), z)
        assert apply(apply(z, cleaning.BOUNDARIES).strip(), cleaning.PERIODS).replace("@@", ".").strip() == y
    assert column(spark, ["(Gomez) The talks failed. (Reporter). ok"], cleaning.interview_format(F.col("text"))) == ['Gomez said: "The talks failed." ok']
    assert column(spark, ["Language: Spanish Article Type:BFN  [Text] a  b"], cleaning.splitter_preclean(F.col("text"))) == ["a b"]
    pairs_ = spark.createDataFrame([("abcdefghij", "abcdefg"), ("abcdefghij", "abcdef"), ("", "a"), ("a", ""), (None, "a"), ("a b c d", "a b c")], "a string, b string")
    assert [r[0] for r in pairs_.select(cleaning.guard_passes(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False, True]


def test_triples(spark):
    raw = '[{"extraction":{"arg1":{"text":" A "},"rel":{"text":"is"},"arg2s":[{"text":"b"},{"text":" "},{"text":"B "}]}},{"extraction":{"arg1":{"text":""},"rel":{"text":"x"},"arg2s":[{"text":"y"}]}}]'
    rows = spark.createDataFrame([(raw,), (None,), ("broken",)], "raw string").select(triples.flattened(F.col("raw")).alias("t"))
    got = rows.select("t", triples.deduplicated(F.col("t")).alias("d"), triples.in_parentheses(F.col("t")).alias("p"), triples.as_sentences(F.col("t"), 1).alias("s")).collect()
    assert [tuple(x) for x in got[0].t] == [("A", "is", "b"), ("A", "is", "B")]
    assert [tuple(x) for x in got[0].d] == [("A", "is", "b")]
    assert got[0].p == "(A; is; b) (A; is; B)" and got[0].s == "A is b."
    assert (got[1].t, got[1].p, got[1].s) == ([], "", None) and got[2].t == []


def test_topics_and_qrels(spark, tmp_path):
    (tmp_path / "topics").write_text("<top>\n<num> Number: 301\n<title> Crime\n<desc> Description:\nWhat  crime?\n<narr> Narrative:\nAll of\nit.\n</top>\n<top>\n<num> Number: 302\n<title> Polio\n\n<narr> Narrative:\nOnly this.\n</top>\n<top>\n<title> none\n</top>\n<top><num> Number: 303\n<title> x\n</top>")
    found = {r.query_id: r.query_text for r in readers.topics(spark, str(tmp_path / "topics")).collect()}
    assert found == {"301": "What crime?. All of it.", "302": "Polio. Only this.", "303": "x."}
    plain = {r.query_id: r.query_text for r in readers.topics(spark, str(tmp_path / "topics"), use_title=False).collect()}
    assert plain == {"301": "What crime?. All of it.", "302": ". Only this.", "303": "."}
    (tmp_path / "more").write_text("<top>\n<num> Number: 1\n<desc> Description:\nzz early\n</top>\n<top>\n<num> Number: 2\n<top>\n<num> Number: 1\n<desc> Description:\naa late\n</top>\n<top>\n<num> Number: 3\n</top>")
    assert {r.query_id: r.query_text for r in readers.topics(spark, str(tmp_path / "more")).collect()} == {"1": "aa late."}
    (tmp_path / "qrels").write_text("301 0 doc1 1\n301\t0  doc2 0\nbad line\n302 0 doc1 1 extra\n")
    assert [(r.query_id, r.document_id, r.label) for r in readers.qrels(spark, str(tmp_path / "qrels")).orderBy("line").collect()] == [("301", "doc1", "1"), ("301", "doc2", "0")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.bounds").write_text("11, 25\nx,7")
    (tmp_path / "docs/b.bounds").write_text("16,31")
    assert {r.document_id: r.bounds for r in readers.bounds(spark, str(tmp_path / "docs")).collect()} == {"a": [11, 25, 7], "b": [16, 31]}
    rows = spark.createDataFrame([("q", 'say "hi"', 1), ("r", "plain", 0)], "query_id string, chunk_text string, label int")
    writers.tsv(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "t"), quoted=True).collect())) == [("q", 'say "hi"', "1"), ("r", "plain", "0")]
    writers.tsv(rows, str(tmp_path / "e"), escaped=True)
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "e")).collect())) == [("q", 'say "hi"', "1"), ("r", "plain", "0")]
    writers.json_report(rows.agg(F.count("*").alias("n")), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0][0] == '{"n":2}'
    writers.text_summary(rows.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).collect()[0][0] == "n: 2"
    writers.csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    writers.packs(pairs.expanded(rows.withColumn("fold", F.lit(1)), 2), str(tmp_path / "p"))
    assert writers.read_pack(spark, str(tmp_path / "p"), 1, "test").count() == 2 and writers.read_pack(spark, str(tmp_path / "p"), 2, "test").count() == 0


def test_tsv_lines_of_any_width(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\tc\n1\t2\t3\n4\t5\n6\t7\t8\t9\n"x\t\ty\nz\n')
    rows = sorted(map(tuple, readers.tsv(spark, str(tmp_path / "t.tsv")).collect()), key=str)
    assert rows == sorted([("1", "2", "3"), ("4", "5", None), ('"x', None, "y"), ("z", None, None)], key=str)
    (tmp_path / "q.tsv").write_text('a\tb\n"1\t1"\t2\n3\n4\t5\t6\n')
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "q.tsv"), quoted=True, schema="a string, b string").collect())) == [("1\t1", "2"), ("3", None)]


def test_drop_reasons_of_repeats(spark):
    """Only what was kept is remembered: a pair whose first row repeats a content is never a kept pair."""
    qrels = spark.createDataFrame([(1, "q", "a", 1), (2, "q", "b", 1), (3, "q", "b", 0), (4, "q", "a", 0), (5, "r", "b", 1), (6, "q", "c", 1), (7, "q", "c", 1), (8, "none", "a", 1)], "line int, query_id string, document_id string, label int")
    topics = spark.createDataFrame([("q", "query"), ("r", "other")], "query_id string, query_text string")
    docs = spark.createDataFrame([("a", "same text"), ("b", "same  text")], "document_id string, document string")
    rows = integrate.judged(integrate.joined(qrels, topics, docs))
    assert {r.line: r.drop_reason for r in rows.collect()} == {1: None, 2: "duplicate_content", 3: "duplicate_content", 4: "duplicate_pair", 5: None, 6: "no_document", 7: "no_document", 8: "no_topic"}


def test_negatives_of_every_smaller_label(spark):
    rows = spark.createDataFrame([("q", i, label) for i, label in enumerate([2, 1, 0, 0])] + [("r", 9, 1)], "query_id string, id int, label int")
    found = pairs.sampled_pairs(rows, "id", num_neg=3).collect()
    by = {}
    for r in found:
        by.setdefault(r.pos_id, set()).add(r.neg_id)
    assert by == {0: {1, 2, 3}, 1: {2, 3}} and len(found) == 5


def test_raw_pairs(spark):
    lines = spark.createDataFrame([("q1\ta\tb\t1",), ("q2\tc\t0",), ("short\tline",), ("query_id\tchunk_text\tlabel",)], "value string")
    assert sorted(map(tuple, readers.parsed_pairs(lines).collect())) == [("q1", "a\tb", "1"), ("q2", "c", "0")]
    assert [tuple(r) for r in readers.parsed_pairs(lines, strict=True).collect()] == [("q2", "c", "0")]


def test_column_names(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "text string, chunk_text string, Query string, y string")
    assert schemas.Resolution(schemas.PAIRS).find(df.columns) == {"query_text": "Query", "chunk_text": "text", "label": "y"}
    assert schemas.Resolution(schemas.PAIRS, "priority").find(df.columns)["chunk_text"] == "chunk_text"
    assert schemas.resolved(df, schemas.Resolution(schemas.PAIRS)).columns == ["query_text", "chunk_text", "label"]
    odd = spark.createDataFrame([("a", "b", "c")], "x string, z string, w string")
    assert schemas.Resolution(schemas.PAIRS, fallback=True).find(odd.columns) == {"query_text": "x", "chunk_text": "z", "label": "w"}
    with pytest.raises(ValueError):
        schemas.resolved(odd, schemas.Resolution(schemas.PAIRS))
    assert schemas.standardized(spark.createDataFrame([("a", 1)], "passage string, score int"), schemas.Resolution(schemas.RANKING)).columns == ["chunk_text", "label"]


def test_embedders_agree(spark):
    values = ["the cat sat on the mat", "", "The CAT"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    many = {r.i: r.v for r in embedding.embedded_once(rows, "text", embedding.Hashed(), "v").collect()}
    one = {r.i: r.v for r in rows.select("i", embedding.Hashed().vector(F.col("text")).alias("v")).collect()}
    assert many == one
    units = hashed_vectors(values)
    for i in (0, 2):
        n = sum(x * x for x in one[i]) ** 0.5
        assert max(abs(a / n - b) for a, b in zip(one[i], units[i])) < 1e-12


def test_streaming_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.chunked(streaming.documents(spark, str(tmp_path / "in"), "doc_id long, text string", 1))
    q = streaming.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    batch = streaming.chunked(docs)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 40), k=st.integers(1, 7))
def test_folds(spark, n, k):
    rows = spark.createDataFrame([(i, i % 2) for i in range(n)], "id int, label int")
    found = pairs.folded(rows, pairs.shuffle_key(1, "id"), k, ["id"], digits=1)
    sizes = {r.fold: r["count"] for r in found.groupBy("fold").count().collect()}
    assert [sizes.get(f, 0) for f in range(1, k + 1)] == [n // k + (f < n % k) for f in range(k)]


def test_extraction(spark):
    from chunklore.operators import extraction

    rows = spark.createDataFrame([(1, "a b c d. x y. p q r"), (2, "a b c d. x y. p q r"), (3, "none"), (4, None)], "i int, chunk_text string")
    found = {r.i: r for r in extraction.enriched(rows, extraction.pattern_extractor).collect()}
    assert found[1].raw_oie_data == found[2].raw_oie_data == "(a; b; c) (p; q; r)"
    assert found[1].raw_oie_data_plus_chunk_text == "a b c d. x y. p q r (a; b; c) (p; q; r)"
    assert (found[3].raw_oie_data, found[3].raw_oie_data_plus_chunk_text) == ("", "none") and found[4].raw_oie_data == ""
    as_json = {r.i: r for r in extraction.enriched(rows, extraction.pattern_extractor, as_json=True).collect()}
    assert as_json[3].raw_oie_data_json == "[]" and '"subject":"a"' in as_json[1].raw_oie_data_json
