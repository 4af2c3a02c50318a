"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as cp
from chunklore.llm.queries import ORACLE, QUERIES

from . import cases
from .test_decontaminate import plain as plain_hits
from .test_linededup import plain as plain_lines
from .test_similar import plain as plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    known = stage("language_id")(spark, docs, sf)
    assert known.columns == COLUMNS
    kept = {r.doc_id: r for r in known.collect()}
    assert all(kept[d] == before[d] for d in kept) and len(kept) >= 0.97 * len(before)

    lined = stage("line_dedup")(spark, docs, sf)
    want = {(d, t) for d, t, _, _ in plain_lines([(r.doc_id, r.text) for r in before.values()]) if t.strip()}
    assert lined.columns == COLUMNS
    assert {(r.doc_id, r.text) for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stage("near_duplicates")(spark, docs, sf)
    want = {c for _, c in plain_groups([(r.doc_id, r.text) for r in before.values()])}
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == want

    clean = stage("decontamination")(spark, docs, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {d for d, r in before.items() if not plain_hits(r.text, items)}


def test_odd_rows(spark, sf, tmp_path):
    docs = cases.frame(spark).select(*COLUMNS)
    for name, f in cp.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == COLUMNS and out.count() <= len(cases.rows())
        assert f(spark, cases.empty(spark).select(*COLUMNS), sf).count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= len(cases.rows())


def test_columns_that_stages_use_themselves(spark, sf):
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "judged", "hits", "n_lines", "n_removed_lines", "n_removed_chunks", "component_id", "stays", "key", "a.b"]
    rows = [(i, cases.prose(i), "en", "s", 1, *(f"{n}{i}" for n in names[5:])) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == names and {tuple(r)[5:] for r in out.collect()} == {r[5:] for r in rows}


def test_texts_of_one_id_stay(spark, sf):
    docs = spark.createDataFrame([(7, cases.prose(1)), (7, cases.prose(2)), (7, cases.prose(1)), (8, cases.prose(2)), (None, cases.prose(3)), (None, cases.prose(2))], "doc_id long, text string")
    assert sorted(cases.collected(cp.near_copies(spark, docs, sf), "doc_id", "text"), key=str) == sorted([(7, cases.prose(1)), (7, cases.prose(2)), (None, cases.prose(3))], key=str)


def test_documents_without_a_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "² ½ ①"), (-4, "12 34 ...")], "doc_id long, text string")
    kept = {r.doc_id for r in cp.language(spark, docs.unionByName(more, allowMissingColumns=True), sf).collect()}
    assert not kept & {-1, -2, -3, -4} and len(kept) >= 0.97 * docs.count()


def test_run(spark, sf):
    out = cp.run(spark, sf).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_every_operator_is_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, d)
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())), name
