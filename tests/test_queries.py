"""Every registered query of the reference operators against DuckDB, and the entry module."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as e
from chunklore.functions import cleaning, text
from chunklore.operators import chunking, contiguous, grouping, signals
from chunklore.plans import registry
from chunklore.plans.queries import ORACLE, QUERIES

from .test_chunkers import plain_split

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_SQL = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(rows):
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT * FROM ({ORACLE[name]}) LIMIT 0").description
    assert columns == sorted(c[0] for c in want)
    names = ", ".join(f'"{c}"' for c in columns)
    got = normal(tuple(r) for r in df.select(*columns).collect())
    assert got == normal(duck.execute(f"SELECT {names} FROM ({ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def sentences_of(spark, sf, clean):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return {r.doc_id: r.s for r in docs.select("doc_id", text.sentences_bounded(clean(docs["text"])).alias("s")).collect()}


def test_contiguous_chunks_are_the_plain_splitter_s(spark, sf):
    found = {}
    for r in QUERIES["contiguous_chunks"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append((r.sent_indices, r.chunk_md5, r.chunk_id))
    checked = 0
    for doc_id, sentences in sentences_of(spark, sf, cleaning.splitter_preclean).items():
        if 2 < len(sentences) <= 90:
            want = [(",".join(map(str, range(a, b))), hashlib.md5(" ".join(sentences[a:b]).encode()).hexdigest(), f"{doc_id}_chunk{i}") for i, (a, b) in enumerate(plain_split(sentences))]
            assert found[doc_id] == want
            checked += 1
    assert checked > 50


def test_groups_and_series_hold_every_sentence_once(spark, sf):
    sentences = sentences_of(spark, sf, cleaning.grouping_preclean)
    members = {}
    for r in QUERIES["semantic_groups"](spark, sf).collect():
        own = list(map(int, r.sent_indices.split(",")))
        assert r.n == len(own) and r.exemplar in own and hashlib.md5(" ".join(sentences[r.doc_id][i] for i in own).encode()).hexdigest() == r.chunk_md5
        members.setdefault(r.doc_id, []).extend(own)
    assert {d: sorted(m) for d, m in members.items()} == {d: list(range(len(s))) for d, s in sentences.items() if s}
    series = {}
    for r in QUERIES["signal_series"](spark, sf).collect():
        series.setdefault(r.doc_id, {})[r.place] = r.similarity
    for doc_id, s in sentences_of(spark, sf, cleaning.splitter_preclean).items():
        v = signals.hashed_vectors(s)
        assert len(series.get(doc_id, {})) == max(0, len(s) - 1)
        assert all(abs(series[doc_id][i] - v[i] @ v[i + 1]) < 1e-5 for i in range(len(s) - 1))


def test_configurations_are_their_chunkers(spark, sf):
    """One pass over all configurations gives what each chunker gives alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    rows = {}
    for r in registry.run(docs, registry.chosen(), clean=False).collect():
        rows.setdefault(r.config, set()).add((r.doc_id, r.chunk_index, r.chunk_id, r.chunk_text))
    assert set(rows) == set(registry.CONFIGS)
    for config in registry.chosen():
        if not isinstance(config.how, registry.Fixed):
            alone = (contiguous.split if isinstance(config.how, registry.Splitter) else grouping.group)(docs, "doc_id", "text", config.how)
            assert {(r.doc_id, r.chunk_index, r.chunk_id, r.chunk_text) for r in chunking.written_form(alone).collect()} == rows[config.name]


def test_configurations_clean_every_text_once(spark):
    """The last rule of each part of the cleaning stands once in the plan of a run, however often its result is used."""
    docs = spark.createDataFrame([(1, "(A) One two three. (B) Four five six seven."), (2, "This document has no information. "), (3, None)], "doc_id long, text string")
    out = registry.run(docs, registry.chosen("text_splitter_char_naive"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Here is a report by ([^:]+)") == 1 and plan.count("and\\.") == 1
    assert {r.doc_id for r in out.collect()} == {1}


def test_group_map_has_the_groups_of_each_document_alone(spark, sf):
    """Documents are grouped many at a time; each gets what it gets alone."""
    found = {}
    for r in QUERIES["group_map"](spark, sf).filter("doc_id < 60").collect():
        found.setdefault(r.doc_id, set()).add(r.sent_indices)
    sentences = {d: x for d, x in sentences_of(spark, sf, cleaning.grouping_preclean).items() if d < 60 and x}
    assert found == {d: {",".join(map(str, g["members"])) for g in grouping.Grouper().groups(x)} for d, x in sentences.items()}


def test_configurations_of_a_kind_share_one_pass(spark, sf):
    """Sentences go to the groupers once and to the splitters once, and shared steps change nothing."""
    out = registry.run(spark.read.parquet(f"{sf}/documents.parquet"), registry.chosen())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(group_sentences") == 1 and plan.count("run(split_sentences") == 1
    documents = list(sentences_of(spark, sf, cleaning.grouping_preclean).values())[:30]
    groupers = [c.how for c in registry.chosen() if isinstance(c.how, grouping.Grouper)]
    assert grouping.grouped(groupers, documents, 3000) == [[how.groups(x) for how in groupers] for x in documents]


def test_entry(spark):
    out = e.entry(spark)
    assert out.count() > 0 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
