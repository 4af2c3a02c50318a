"""The registered queries on the reference operators, each beside the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, labels, text, triples, vectors
from ..operators import boundaries, chunking, contiguous, embedding, integrate, metrics, pairs, profile, ranking
from ..sources import readers
from .. import schemas
from ..sources import writers
from . import base as b
from .base import sql_collapse, sql_ended, sql_full, sql_profile_sentences, sql_rules, sql_split_after, sql_strict_sentences, sql_strip, sql_tokens, sql_words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _joined(parts: str) -> str:
    return f"md5(array_to_string({parts}, chr(10)))"


def _digest(c):
    return F.md5(F.array_join(c, "\n"))


# sentences, words, lengths

_A, _B, _C = sql_profile_sentences("text"), sql_full(sql_split_after("text", ".!?！？。")), sql_strict_sentences("text")
_E = sql_full(sql_split_after("text", ".!?", "[A-Z]"))


@query(f"""SELECT doc_id, len({_A})::INT AS n_profile, {_joined(_A)} AS profile, len({_B})::INT AS n_chunk_profile, {_joined(_B)} AS chunk_profile,
  len({_C})::INT AS n_strict, {_joined(_C)} AS strict, len({_E})::INT AS n_plain, {_joined(_E)} AS plain FROM documents""")
def sentence_split(spark, d):
    t = F.col("text")
    kinds = {"profile": text.sentences_profile(t), "chunk_profile": text.sentences_chunk_profile(t), "strict": text.sentences_strict(t), "plain": text.sentences_plain(t)}
    return b.documents(spark, d).select("doc_id", *[x for k, c in kinds.items() for x in (F.size(c).alias(f"n_{k}"), _digest(c).alias(k))])


@query(f"""SELECT doc_id, len({sql_words("text")})::INT AS n_words, len({sql_tokens("text")})::INT AS n_tokens,
  len(regexp_extract_all(text, '{b.WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]'))::INT AS n_marks_too, {_joined(sql_tokens("text"))} AS tokens FROM documents""")
def word_tokens(spark, d):
    t = F.col("text")
    return b.documents(spark, d).select("doc_id", F.size(text.words(t)).alias("n_words"), F.size(text.word_tokens(t)).alias("n_tokens"), text.token_count(t).alias("n_marks_too"), _digest(text.word_tokens(t)).alias("tokens"))


_BOUNDED = f"""parts AS (SELECT doc_id, {sql_full(sql_split_after(sql_strip(sql_collapse('text')), '.!?', '[A-Z]'))} AS p FROM documents),
bounded AS (SELECT doc_id, list_transform(list_filter(flatten(list_transform(p, lambda t: CASE WHEN length(t) > 1000 THEN {sql_full(sql_split_after('t', '.!?;'))} ELSE [t] END)), lambda s: length(s) >= 10), lambda s: {sql_ended('s')}) AS c FROM parts),
clauses AS (SELECT doc_id, c, {sql_full("flatten(list_transform(c, lambda t: string_split(t, ';')))")} AS h FROM bounded),
simple AS (SELECT doc_id, c, flatten(list_transform(h, lambda p: list_transform([string_split_regex(p, ',{b.BLANK}+(?:and|but|or){b.BLANK}+')], lambda t: CASE WHEN len(t) >= 2 AND len({sql_words('t[1]')}) >= 4 AND len({sql_words('t[2]')}) >= 4
  THEN list_transform([{sql_strip('t[1]')}, {sql_strip('t[2]')}], lambda s: CASE WHEN ends_with(s, '.') THEN s ELSE s || '.' END) ELSE [p] END)[1])) AS x FROM clauses)"""


@query(f"WITH {_BOUNDED} SELECT doc_id, len(c)::INT AS n_bounded, {_joined('c')} AS bounded, len(x)::INT AS n_simplified, {_joined('x')} AS simplified FROM simple")
def sentence_split_bounded(spark, d):
    """Sentences over 1,000 characters cut once more, and the simplified form."""
    t = F.col("text")
    c, s = text.sentences_bounded(t), text.simplified(text.sentences_bounded(t))
    return b.documents(spark, d).select("doc_id", F.size(c).alias("n_bounded"), _digest(c).alias("bounded"), F.size(s).alias("n_simplified"), _digest(s).alias("simplified"))


_LENGTHS = f"SELECT doc_id, len({sql_words('text')})::INT AS word_count, len({_A})::INT AS sentence_count FROM documents"


@query(f"SELECT *, round(CASE WHEN sentence_count > 0 THEN word_count / sentence_count::DOUBLE ELSE 0 END, 9) AS avg_words_per_sentence FROM ({_LENGTHS})")
def doc_lengths(spark, d):
    return profile.lengths(b.documents(spark, d), "text").drop("text").withColumn("avg_words_per_sentence", F.round("avg_words_per_sentence", 9))


def _described(column: str, source: str, places: int) -> str:
    q = lambda p: f"round(quantile_cont({column}, {p}), {places})"
    return f"""SELECT '{column}' AS measure, count(*) AS count, min({column}) AS min, max({column}) AS max, round(avg({column}), {places}) AS mean, {q(0.5)} AS median,
  {q(0.1)} AS p10, {q(0.25)} AS p25, {q(0.75)} AS p75, {q(0.9)} AS p90, round(stddev_pop({column}), {places}) AS std FROM {source}"""


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


@query(f"WITH l AS ({_LENGTHS}) {_described('word_count', 'l', 6)} UNION ALL {_described('sentence_count', 'l', 6)}")
def doc_length_stats(spark, d):
    rows = profile.lengths(b.documents(spark, d), "text").unpivot([], ["word_count", "sentence_count"], "measure", "value")
    return _rounded(profile.described(rows, "value", by=("measure",)), 6, "mean", "median", "p10", "p25", "p75", "p90", "std")


@query(f"SELECT round(sum(word_count)::DOUBLE / sum(sentence_count), 9) AS words_per_sentence FROM ({_LENGTHS})")
def words_per_sentence(spark, d):
    return _rounded(profile.overall_ratio(profile.lengths(b.documents(spark, d), "text")), 9, "words_per_sentence")


@query(f"SELECT sentence_count, count(*) AS n_documents FROM ({_LENGTHS}) GROUP BY ALL")
def sentence_distribution(spark, d):
    return profile.distribution(profile.lengths(b.documents(spark, d), "text"))


@query(f"""SELECT b.bucket, count(l.doc_id) AS n_documents FROM (VALUES ('0', 0, 0), ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4-5', 4, 5), ('6-10', 6, 10), ('11-20', 11, 20), ('21-50', 21, 50), ('51+', 51, 2000000000)) b(bucket, a, z)
  LEFT JOIN ({_LENGTHS}) l ON l.sentence_count BETWEEN a AND z GROUP BY b.bucket""")
def sentence_buckets(spark, d):
    return profile.bucketed(profile.lengths(b.documents(spark, d), "text"))


# chunks


@query(f"SELECT *, doc_id || '_chunk' || chunk_index AS chunk_id FROM ({b.sql_fixed('documents', 'doc_id')})")
def fixed_chunks(spark, d):
    return b.all_chunks(spark, d).drop("start", "end")


@query(f"SELECT *, chunk_index * 100 AS start, chunk_index * 100 + length(chunk_text)::INT AS \"end\" FROM ({b.sql_fixed('documents', 'doc_id', 150, 50)})")
def fixed_chunks_overlap(spark, d):
    return b.all_chunks(spark, d, 150, 50).drop("chunk_id")


_CHUNKS = f"chunks AS ({b.sql_fixed('documents', 'doc_id')})"
_CHUNK_TEXT = sql_strip("translate(chunk_text, chr(9) || chr(10) || chr(13), '   ')")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, md5(t) AS chunk_md5 FROM (SELECT *, {_CHUNK_TEXT} AS t FROM chunks) WHERE t <> ''")
def chunk_written_form(spark, d):
    return chunking.written_form(b.all_chunks(spark, d)).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"))


@query(f"""WITH {_CHUNKS} SELECT doc_id, chunk_index, len({sql_strict_sentences('chunk_text')})::INT AS sentences, len({sql_words('chunk_text')})::INT AS words,
  len(regexp_extract_all(chunk_text, '{b.WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]'))::INT AS tokens, length(chunk_text)::INT AS chars FROM chunks""")
def chunk_eval(spark, d):
    return chunking.measured(b.all_chunks(spark, d), "doc_id", "chunk_index")


def _summary(m: str) -> str:
    q = lambda p: f"round(quantile_cont({m}, {p}), 6)"
    return f"SELECT '{m}' AS measure, count(*) AS count, min({m}) AS min, max({m}) AS max, round(avg({m}), 6) AS mean, {q(0.5)} AS p50, {q(0.9)} AS p90, {q(0.95)} AS p95 FROM m"


@query(f"""WITH {_CHUNKS}, m AS (SELECT len({sql_strict_sentences('chunk_text')}) AS sentences, len({sql_words('chunk_text')}) AS words,
  len(regexp_extract_all(chunk_text, '{b.WORD}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) AS tokens, length(chunk_text) AS chars FROM chunks),
p AS (SELECT count(*) AS chunks_per_document FROM chunks GROUP BY doc_id)
{' UNION ALL '.join(_summary(x) for x in ('sentences', 'words', 'tokens', 'chars'))} UNION ALL {_summary('chunks_per_document').replace('FROM m', 'FROM p')}""")
def eval_summary(spark, d):
    chunks = b.all_chunks(spark, d)
    return _rounded(profile.evaluation_summary(chunking.measured(chunks), profile.chunks_per_document(chunks, "doc_id")), 6, "mean", "p50", "p90", "p95")


@query(f"WITH {_CHUNKS}, w AS (SELECT len({sql_words('chunk_text')})::INT AS words FROM chunks) " + _described("words", "w", 3).replace("'words' AS measure, ", ""))
def chunk_profile(spark, d):
    sized = b.all_chunks(spark, d).select(F.size(text.words(F.col("chunk_text"))).alias("words"))
    return _rounded(profile.described(sized, "words", places=3), 3, "median", "p10", "p25", "p75", "p90")


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def chunks_per_document(spark, d):
    return profile.chunks_per_document(b.all_chunks(spark, d), "doc_id")


@query(f"WITH {_CHUNKS}, k AS (SELECT count(*) AS n FROM chunks GROUP BY chunk_text) SELECT sum(n)::BIGINT AS n_chunks, count(*) FILTER (n > 1) AS n_duplicated, round(sum(n - 1)::DOUBLE / sum(n), 4) AS duplicate_ratio FROM k")
def duplicate_chunks(spark, d):
    return profile.duplicates(b.all_chunks(spark, d))


@query(f"WITH {_CHUNKS} SELECT chunk_text, count(*) AS n FROM chunks GROUP BY chunk_text HAVING count(*) > 1 ORDER BY n DESC, chunk_text LIMIT 5")
def top_duplicate_chunks(spark, d):
    return profile.top_duplicates(b.all_chunks(spark, d))


_TOKENS = f"{_CHUNKS}, t AS (SELECT token, count(*) AS n FROM (SELECT unnest({sql_tokens('chunk_text')}) AS token FROM chunks) GROUP BY token)"


@query(f"WITH {_TOKENS} SELECT count(*) AS n_types, sum(n)::BIGINT AS n_tokens, round(count(*) / sum(n)::DOUBLE, 4) AS type_token_ratio, round(sum(n)::DOUBLE / (SELECT count(*) FROM chunks), 3) AS tokens_per_chunk FROM t")
def vocabulary_stats(spark, d):
    return profile.vocabulary_stats(b.all_chunks(spark, d))


@query(f"WITH {_TOKENS} SELECT token, n FROM t ORDER BY n DESC, token LIMIT 20")
def top_tokens(spark, d):
    return profile.top_tokens(b.all_chunks(spark, d))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, len({sql_words('chunk_text')})::INT AS n_words, substr(replace(chunk_text, chr(10), ' '), 1, 130) AS preview FROM chunks ORDER BY n_words DESC, doc_id, chunk_index LIMIT 10")
def longest_chunks(spark, d):
    return profile.longest(b.all_chunks(spark, d), "doc_id", "chunk_index")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE doc_id IN (SELECT DISTINCT doc_id FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 50)")
def document_limit(spark, d):
    return profile.first_documents(b.all_chunks(spark, d), 50, "doc_id", "doc_id").select("doc_id", "chunk_index")


@query(f"""WITH {_CHUNKS}, f AS (SELECT 'config_' || chunk_index % 3 AS file, len({sql_words('chunk_text')}) AS w FROM chunks)
  SELECT file, count(*) AS n_chunks, round(avg(w), 3) AS mean_words, max(w)::INT AS max_words FROM f GROUP BY file""")
def file_comparison(spark, d):
    return profile.compared_files(b.all_chunks(spark, d).withColumn("file", F.concat(F.lit("config_"), (F.col("chunk_index") % 3).cast("string"))))


# ranking


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    return b.judged_chunks(spark, d), b.queries(spark, d)


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, round(bm25_score, 6) AS bm25_score FROM bm25")
def bm25_scores(spark, d):
    return _rounded(ranking.bm25(*_scored(spark, d)), 6, "bm25_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, round(cosine_score, 6) AS cosine_score FROM cosines")
def cosine_hashed(spark, d):
    return _rounded(ranking.cosine(*_scored(spark, d)), 6, "cosine_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, r1::INT AS rank FROM ranks")
def rank_by_bm25(spark, d):
    return ranking.ranked(ranking.bm25(*_scored(spark, d)), "bm25_score", "rank").drop("bm25_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, r2::INT AS rank FROM ranks")
def rank_by_cosine(spark, d):
    return ranking.ranked(ranking.cosine(*_scored(spark, d)), "cosine_score", "rank").drop("cosine_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, round(rrf_score, 8) AS rrf_score FROM fused")
def rrf_fusion(spark, d):
    return _rounded(ranking.fused(*_scored(spark, d)), 8, "rrf_score").drop("bm25_score", "cosine_score")


@query(f"""WITH {b.RANKED},
a AS (SELECT query_id, document_id || '_chunk' || chunk_index AS chunk_id, bm25_score FROM bm25 WHERE bm25_score > 0),
c AS (SELECT query_id, document_id || '_chunk' || chunk_index AS chunk_id, cosine_score FROM cosines WHERE chunk_index < 2),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM a),
rc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine_score DESC, chunk_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM c),
j AS (SELECT coalesce(ra.query_id, rc.query_id) AS query_id, coalesce(ra.chunk_id, rc.chunk_id) AS chunk_id, bm25_score, cosine_score, ra.r AS r1, rc.r AS r2, ra.n AS n1, rc.n AS n2
  FROM ra FULL JOIN rc ON ra.query_id = rc.query_id AND ra.chunk_id = rc.chunk_id),
k AS (SELECT *, greatest(coalesce(max(n1) OVER (PARTITION BY query_id), 0), coalesce(max(n2) OVER (PARTITION BY query_id), 0)) + 60 AS m FROM j)
SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, round(cosine_score, 6) AS cosine_score, round(1.0 / (60 + coalesce(r1, m)) + 1.0 / (60 + coalesce(r2, m)), 8)::DOUBLE AS rrf_score FROM k""")
def rrf_outer(spark, d):
    chunks, queries = _scored(spark, d)
    named = lambda df: df.withColumn("chunk_id", F.concat(F.col("document_id").cast("string"), F.lit("_chunk"), F.col("chunk_index").cast("string")))
    left = named(ranking.bm25(chunks, queries).filter("bm25_score > 0"))
    right = named(ranking.cosine(chunks, queries).filter("chunk_index < 2"))
    out = ranking.fused_lists(left, right, "bm25_score", "cosine_score", "chunk_id")
    return _rounded(_rounded(out, 6, "bm25_score", "cosine_score"), 8, "rrf_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, round(bm25_score, 6) AS bm25_score, round(cosine_score, 6) AS cosine_score, round(rrf_score, 8) AS rrf_score, label FROM labelled")
def percentile_labels(spark, d):
    out = ranking.percentile_labelled(ranking.fused(*_scored(spark, d)))
    return _rounded(_rounded(out, 6, "bm25_score", "cosine_score"), 8, "rrf_score")


@query(f"WITH {b.RANKED} SELECT query_id, document_id, chunk_index, (cosine_score >= 0.6)::INT AS label FROM cosines WHERE cosine_score >= 0.6 OR cosine_score <= 0.4")
def fixed_threshold_labels(spark, d):
    return ranking.threshold_labelled(ranking.cosine(*_scored(spark, d))).drop("cosine_score")


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT label, v FROM (SELECT e.label, u.v, row_number() OVER (PARTITION BY e.label ORDER BY vec_id) AS n FROM u JOIN embeddings e USING (vec_id)) WHERE n = 1)
  SELECT u.vec_id, round(list_dot_product(u.v, q.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS cosine_score FROM u JOIN embeddings e USING (vec_id) JOIN q ON q.label = e.label""")
def cosine_precomputed(spark, d):
    """Each vector against the first one of its label."""
    e = b.table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(first, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine_score"))


@query(f"""WITH queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), qrels AS ({b.WIDE_QRELS})
  SELECT q.query_id, q.document_id, coalesce(t.query_text, '') AS query_text FROM qrels q LEFT JOIN queries t USING (query_id)""")
def query_text_join(spark, d):
    return ranking.with_query_text(b.wide_qrels(spark, d), b.queries(spark, d)).select("query_id", "document_id", "query_text")


@query(f"SELECT md5(text) AS text_md5, round(sqrt(sum(v * v)), 6) AS length, count(*) AS n_buckets FROM (SELECT text, {b.sql_bucket('token')} AS bucket, count(*)::DOUBLE AS v FROM (SELECT text, unnest({sql_words('lower(text)')}) AS token FROM (SELECT DISTINCT text FROM documents)) GROUP BY ALL) GROUP BY text")
def hashed_embeddings(spark, d):
    """Every distinct text embedded once."""
    rows = embedding.embedded_once(b.documents(spark, d), "text", embedding.Hashed(), "vector").select(F.md5("text").alias("text_md5"), "vector").dropDuplicates(["text_md5"])
    return rows.select("text_md5", F.round(vectors.norm(F.col("vector")), 6).alias("length"), F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets")).filter("n_buckets > 0")


# integration

_CLEAN = lambda x: f"replace(replace({sql_strip(sql_collapse(x))}, '\"\"', '\"'), '\"', '''')"
_DOC_CLEAN = _CLEAN("replace(d.text, chr(13), '')")
# every judgement twice, a copy of its document twice for the same query, and a document that isn't there
_INTEGRATE = f"""given AS (SELECT doc_id, doc_id % ({b.N_QUERIES} + 5) AS query_id, quality AS label FROM labels),
qrels AS (SELECT 5 * doc_id + k AS line, query_id, CASE WHEN k < 2 THEN doc_id WHEN k < 4 THEN -1 - doc_id ELSE 1000000000000 + doc_id END AS document_id, label FROM given, range(0, 5) r(k)),
t AS (SELECT item_id AS query_id, {_CLEAN("text")} AS query_text FROM benchmark),
d AS (SELECT doc_id AS document_id, {_DOC_CLEAN} AS document FROM documents d UNION ALL SELECT -1 - doc_id, {_DOC_CLEAN} FROM documents d),
rows AS (SELECT q.*, t.query_text, d.document FROM qrels q LEFT JOIN t USING (query_id) LEFT JOIN d USING (document_id)),
first AS (SELECT *, CASE WHEN query_text IS NULL THEN 'no_topic' WHEN length(query_text) < 1 THEN 'short_query' WHEN document IS NULL THEN 'no_document'
  WHEN document = 'This document has no information.' THEN 'no_information' WHEN length(document) < 100 THEN 'short_document' END AS r0 FROM rows),
pairs_kept AS (SELECT query_id, document, min(line) AS line, arg_min(document_id, line) AS document_id FROM first WHERE r0 IS NULL GROUP BY ALL),
third AS (SELECT f.*, CASE WHEN r0 IS NOT NULL THEN r0 WHEN k.line = f.line THEN NULL WHEN k.document_id = f.document_id THEN 'duplicate_pair' ELSE 'duplicate_content' END AS drop_reason
  FROM first f LEFT JOIN pairs_kept k ON k.query_id = f.query_id AND k.document = f.document)"""


def _joined_qrels(spark, d) -> DataFrame:
    k = F.col("k")
    document = F.when(k < 2, F.col("document_id")).when(k < 4, -1 - F.col("document_id")).otherwise(F.lit(1000000000000) + F.col("document_id"))
    qrels = b.wide_qrels(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((5 * F.col("document_id") + k).alias("line"), "query_id", document.alias("document_id"), "label")
    docs = b.documents(spark, d).select(F.explode(F.array(F.col("doc_id"), -1 - F.col("doc_id"))).alias("document_id"), F.col("text").alias("document"))
    return integrate.joined(qrels, b.queries(spark, d), docs, 1, 100)


def _integrated(spark, d) -> DataFrame:
    return integrate.judged(_joined_qrels(spark, d))


@query(f"WITH {_INTEGRATE} SELECT line, query_id, document_id, md5(query_text) AS query_md5, md5(document) AS document_md5, r0 AS drop_reason FROM first")
def integrate_filter(spark, d):
    return _joined_qrels(spark, d).select("line", "query_id", "document_id", F.md5("query_text").alias("query_md5"), F.col("content").alias("document_md5"), "drop_reason")


@query(f"WITH {_INTEGRATE} SELECT line, query_id, document_id, label FROM third WHERE drop_reason IS NULL")
def integrate_dedup(spark, d):
    return _integrated(spark, d).filter("drop_reason IS NULL").select("line", "query_id", "document_id", "label")


@query(f"WITH {_INTEGRATE} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM third GROUP BY ALL")
def drop_reasons(spark, d):
    return integrate.drop_counts(_integrated(spark, d))


def _flat(x: str) -> str:
    return sql_strip(sql_collapse(x))


# of four topics one has all parts, one no narrative, one no description, one no title either
_TOPIC = f"""parts AS (SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 4 < 2 THEN {_flat('substr(text, 1, 40)')} ELSE '' END AS descr,
  CASE WHEN item_id % 4 <> 1 THEN {_flat('substr(text, 41)')} ELSE '' END AS narr, CASE WHEN item_id % 4 < 3 THEN 'A title' ELSE '' END AS title FROM benchmark)"""
_TOPIC_TEXT, _PLAIN_TOPIC_TEXT = "CASE WHEN descr <> '' THEN descr || '. ' || narr WHEN title <> '' THEN title || '. ' || narr ELSE narr END", "descr || '. ' || narr"


def _topic_blocks(spark, d) -> DataFrame:
    """Files of two blocks with one number, of which the last counts, and one without."""
    kind, short, rest = F.col("item_id") % 4, F.substring("text", 1, 40), F.expr("substr(text, 41)")
    number = F.concat(F.lit("<top>\n<num> Number: "), F.col("item_id").cast("string"))
    block = F.concat(
        number,
        F.when(kind < 3, F.lit("\n<title> A title")).otherwise(""),
        F.when(kind < 2, F.concat(F.lit("\n<desc> Description:\n"), short)).otherwise(""),
        F.when(kind != 1, F.concat(F.lit("\n<narr> Narrative:\n"), rest)).otherwise(""),
        F.lit("\n</top>\n"),
    )
    early = F.concat(number, F.lit("\n<title> zz\n<desc> Description:\n~ replaced\n<narr> Narrative:\n~ later\n</top>\n"))
    return b.table(spark, d, "benchmark").select(F.concat(early, block, F.lit("<top>\n<title> no number\n</top>")).alias("value")).filter("value IS NOT NULL")


@query(f"WITH {_TOPIC}, t AS (SELECT query_id, {_flat(_TOPIC_TEXT)} AS query_text FROM parts) SELECT * FROM t WHERE query_text <> ''")
def trec_topics(spark, d):
    """Topics written from the benchmark and read back, the title where there is no description."""
    return readers.parsed_topics(_topic_blocks(spark, d))


@query(f"WITH {_TOPIC} SELECT query_id, {_flat(_PLAIN_TOPIC_TEXT)} AS query_text FROM parts")
def trec_topics_plain(spark, d):
    """The same without titles: a missing part leaves the full stop."""
    return readers.parsed_topics(_topic_blocks(spark, d), use_title=False)


@query("SELECT (doc_id % 40)::VARCHAR AS query_id, doc_id::VARCHAR AS document_id, quality::VARCHAR AS label FROM labels WHERE doc_id % 11 <> 0")
def qrels_scan(spark, d):
    line = F.concat_ws("  ", (F.col("doc_id") % 40).cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("quality").cast("string"), F.when(F.col("doc_id") % 11 == 0, F.lit("extra")))
    return readers.parsed_qrels(b.table(spark, d, "labels").select(line.alias("value")))


@query("SELECT doc_id::VARCHAR AS query_id, replace(text, chr(10), chr(9)) AS chunk_text, (doc_id % 2)::VARCHAR AS label FROM documents WHERE text IS NOT NULL")
def raw_pair_lines(spark, d):
    """Whole texts as lines whose tabs belong to the middle field."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace(F.col("text"), F.lit("\n"), F.lit("\t")), F.lit("\t"), (F.col("doc_id") % 2).cast("string"))
    return readers.parsed_pairs(b.documents(spark, d).select(line.alias("value")).filter("value IS NOT NULL"))


@query("""SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex(s, '[,\\n]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::INT)::VARCHAR AS bounds
  FROM (SELECT doc_id, doc_id % 7 || ', ' || doc_id % 13 || chr(10) || 'x,' || doc_id AS s FROM documents)""")
def bounds_scan(spark, d):
    s = F.concat((F.col("doc_id") % 7).cast("string"), F.lit(", "), (F.col("doc_id") % 13).cast("string"), F.lit("\nx,"), F.col("doc_id").cast("string"))
    return b.documents(spark, d).select("doc_id", F.concat(F.lit("["), F.array_join(readers.parsed_bounds(s).cast("array<string>"), ", "), F.lit("]")).alias("bounds"))


@query(f"""WITH known AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), qrels AS ({b.WIDE_QRELS})
  SELECT k.query_text, d.text AS chunk_text, q.label FROM qrels q JOIN known k USING (query_id) JOIN documents d ON d.doc_id = q.document_id""")
def query_mapping(spark, d):
    docs = b.documents(spark, d).select(F.col("doc_id").alias("document_id"), F.col("text").alias("chunk_text"))
    return integrate.mapped(b.wide_qrels(spark, d).join(docs, "document_id"), b.queries(spark, d))


@query(f"WITH qrels AS ({b.WIDE_QRELS}) SELECT query_id, count(*) AS n_skipped FROM qrels WHERE query_id NOT IN (SELECT item_id FROM benchmark) GROUP BY ALL")
def query_mapping_skipped(spark, d):
    return integrate.unmapped(b.wide_qrels(spark, d), b.queries(spark, d))


# labels and pairs

_LABEL_TEXT = "CASE doc_id % 12 WHEN 0 THEN '1' WHEN 1 THEN ' 1.9 ' WHEN 2 THEN '-0.5' WHEN 3 THEN 'nan' WHEN 4 THEN 'inf' WHEN 5 THEN '' WHEN 6 THEN 'yes' WHEN 7 THEN '-1' WHEN 8 THEN 'Relevant' WHEN 9 THEN '0' WHEN 10 THEN '2e0' ELSE 'x' END"
_NUMERIC = "CASE WHEN isfinite(try_cast(trim(l) AS DOUBLE)) THEN trunc(try_cast(trim(l) AS DOUBLE))::INT END"


@query(f"SELECT doc_id, ({_NUMERIC})::VARCHAR AS label FROM (SELECT doc_id, {_LABEL_TEXT} AS l FROM documents)")
def label_parse(spark, d):
    return b.documents(spark, d).select("doc_id", labels.numeric_label(F.expr(_LABEL_TEXT)).cast("string").alias("label"))


@query(f"""SELECT doc_id, (CASE WHEN lower(trim(l)) IN ('1', '+1', 'true', 'yes', 'y', 'relevant', 'rel', 'pos', '+', 'positive') THEN 1
  WHEN lower(trim(l)) IN ('0', '-1', 'false', 'no', 'n', 'irrelevant', 'nonrelevant', 'neg', '-', 'negative') THEN 0 ELSE {_NUMERIC} END)::VARCHAR AS label FROM (SELECT doc_id, {_LABEL_TEXT} AS l FROM documents)""")
def label_map(spark, d):
    return b.documents(spark, d).select("doc_id", labels.mapped_label(F.expr(_LABEL_TEXT)).cast("string").alias("label"))


_NORMAL = lambda x: sql_strip(sql_collapse(f"coalesce({x}, '')"))
_PAIRS = f"""raw AS (SELECT d.doc_id, b.text AS q, d.text AS c, {_LABEL_TEXT.replace('doc_id', 'd.doc_id')} AS l
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % {b.N_QUERIES}),
norm AS (SELECT doc_id, {_NORMAL("q")} AS query_text, {_NORMAL("c")} AS chunk_text, {_NUMERIC} AS label FROM raw),
checked AS (SELECT *, CASE WHEN label IS NULL THEN 'bad_label' WHEN query_text = '' OR chunk_text = '' THEN 'empty_text' WHEN length(query_text) < 20 OR length(chunk_text) < 20 THEN 'short_text' END AS drop_reason FROM norm),
valid AS (SELECT * FROM checked WHERE drop_reason IS NULL),
pair AS (SELECT query_text, count(*) FILTER (label > 0) AS pos, count(*) FILTER (label <= 0) AS neg, count(*) AS total FROM valid GROUP BY query_text),
status AS (SELECT *, CASE WHEN pos > 0 AND neg > 0 THEN 'pairable' WHEN pos > 0 THEN 'only_pos' ELSE 'only_neg' END AS status FROM pair)"""


def _raw_pairs(spark, d) -> DataFrame:
    n = b.table(spark, d, "benchmark").count()
    docs = b.documents(spark, d).select((F.col("doc_id") % n).alias("query_id"), F.col("text").alias("chunk_text"), F.expr(_LABEL_TEXT).alias("label"))
    return docs.join(b.queries(spark, d), "query_id")


@query(f"WITH {_PAIRS} SELECT query_text, chunk_text, label FROM valid")
def validate_pairs(spark, d):
    return pairs.valid(_raw_pairs(spark, d), 20)


@query(f"""WITH {_PAIRS} SELECT count(*) AS rows_in, count(*) FILTER (drop_reason IS NULL) AS rows_kept, count(*) FILTER (drop_reason = 'bad_label') AS bad_label, count(*) FILTER (drop_reason = 'empty_text') AS empty_text,
  count(*) FILTER (drop_reason = 'short_text') AS short_text, (SELECT count(*) FROM status) AS queries, (SELECT count(*) FILTER (status = 'pairable') FROM status) AS pairable, (SELECT count(*) FILTER (status = 'only_pos') FROM status) AS only_pos,
  (SELECT count(*) FILTER (status = 'only_neg') FROM status) AS only_neg, (SELECT coalesce(sum(total) FILTER (status <> 'pairable'), 0)::BIGINT FROM status) AS unpairable_rows FROM checked""")
def validation_report(spark, d):
    return pairs.validation_report(_raw_pairs(spark, d), 20)


@query(f"WITH {_PAIRS} SELECT * FROM status")
def pairability(spark, d):
    return pairs.pairability(pairs.valid(_raw_pairs(spark, d), 20))


@query(f"WITH {_PAIRS} SELECT query_text, chunk_text, label FROM valid WHERE query_text IN (SELECT query_text FROM status WHERE status = 'pairable')")
def drop_unpairable(spark, d):
    return pairs.pairable_only(pairs.valid(_raw_pairs(spark, d), 20))


@query(f"WITH {_PAIRS} SELECT count(DISTINCT query_text) AS n_left, count(DISTINCT chunk_text) AS n_right FROM valid")
def distinct_texts(spark, d):
    return pairs.distinct_texts(pairs.valid(_raw_pairs(spark, d), 20), "query_text", "chunk_text")


@query(f"SELECT quality AS label, count(*) AS n_rows, count(DISTINCT doc_id % {b.N_QUERIES}) AS n_query_id, count(DISTINCT doc_id) AS n_document_id FROM labels GROUP BY quality")
def label_distribution(spark, d):
    return profile.label_distribution(b.qrels(spark, d), "query_id", "document_id")


# folds and sampling

_FOLD = f"folds AS (SELECT query_id, document_id, label, ntile(5) OVER (ORDER BY md5('42|' || query_id || '|' || document_id), document_id)::INT AS own FROM ({b.QRELS}))"


def _folded(spark, d) -> DataFrame:
    return pairs.folded(b.qrels(spark, d), pairs.shuffle_key(42, "query_id", "document_id"), 5, ["document_id"])


@query(f"WITH {_FOLD} SELECT query_id, document_id, label, own AS fold FROM folds")
def kfold(spark, d):
    return _folded(spark, d)


@query(f"WITH {_FOLD} SELECT query_id, document_id, label, f::INT AS fold, CASE WHEN f = own THEN 'test' ELSE 'train' END AS split FROM folds, range(1, 6) r(f)")
def fold_expand(spark, d):
    return pairs.expanded(_folded(spark, d), 5)


@query(f"""WITH rows AS (SELECT doc_id % {b.N_QUERIES} AS query_id, doc_id AS document_id, quality * (2 - toxic) AS label FROM labels),
low AS (SELECT query_id, document_id AS neg_id, label, row_number() OVER (PARTITION BY query_id ORDER BY label, md5('42|' || query_id || '|' || document_id), document_id) - 1 AS nth FROM rows),
high AS (SELECT r.query_id, r.document_id AS pos_id, (SELECT count(*) FROM rows s WHERE s.query_id = r.query_id AND s.label < r.label) AS n FROM rows r),
drawn AS (SELECT h.*, d.dup::INT AS dup, w.draw::INT AS draw, ('0x' || substr(md5('42|' || h.query_id || '|' || pos_id || '|' || d.dup), 1, 7))::BIGINT AS k FROM high h, range(0, 2) d(dup), range(0, 3) w(draw) WHERE w.draw < h.n)
SELECT d.query_id, pos_id, neg_id, dup, draw FROM drawn d JOIN low l ON l.query_id = d.query_id AND l.nth = (k + draw) % d.n""")
def pair_sampling(spark, d):
    """Three labels: bad, good, and good and not toxic."""
    label = F.col("quality") * (2 - F.col("toxic"))
    return pairs.sampled_pairs(b.qrels(spark, d, label), "document_id", num_neg=3, num_dup=2)


@query(f"SELECT query_id, document_id, label FROM ({b.QRELS})")
def point_sampling(spark, d):
    return b.qrels(spark, d)


@query(f"WITH q AS (SELECT query_id, count(*) FILTER (label > 0) AS pos, count(*) FILTER (label <= 0) AS neg FROM ({b.QRELS}) GROUP BY query_id) SELECT count(*) FILTER (pos > 0 AND neg > 0) AS n_pairable, CASE WHEN count(*) FILTER (pos > 0 AND neg > 0) > 0 THEN 'pair' ELSE 'point' END AS mode FROM q")
def pairable_check(spark, d):
    n = pairs.pairability(b.qrels(spark, d), "query_id").agg(F.count_if(F.col("status") == "pairable").alias("n_pairable"))
    return n.withColumn("mode", F.when(F.col("n_pairable") > 0, "pair").otherwise("point"))


@query(f"SELECT token, count(*) AS n_documents FROM (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token HAVING count(*) >= 5")
def vocabulary(spark, d):
    return pairs.vocabulary(b.documents(spark, d), "text")


def _ids(words: str) -> str:
    return f"list_transform(list_slice({words}, 1, 16), lambda w: ('0x' || substr(md5(w), 1, 4))::INT)"


@query(f"SELECT doc_id, array_to_string(list_concat(list_transform(range(16 - len({_ids(sql_tokens('text'))})), lambda x: 0), {_ids(sql_tokens('text'))}), ',') AS ids FROM documents")
def pad_sequences(spark, d):
    ids = F.transform(text.word_tokens(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))
    return b.documents(spark, d).select("doc_id", F.array_join(pairs.padded(ids, 16).cast("array<string>"), ",").alias("ids"))


# metrics: three rankings of the judged chunks as models, queries dealt over three folds

_SCORES = f"""{b.RANKED},
scores AS (
  SELECT m.model, (f.query_id % 3 + 1)::INT AS fold, f.query_id, f.document_id * 100000 + f.chunk_index AS item_id, c.label, m.score
  FROM fused f JOIN chunks c USING (query_id, document_id, chunk_index), LATERAL (VALUES ('bm25', f.bm25_score), ('cosine', f.cosine_score), ('rrf', f.rrf_score)) m(model, score)),
placed AS (
  SELECT *, (label > 0)::INT AS rel, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, item_id) AS pos, row_number() OVER (PARTITION BY model, query_id ORDER BY label DESC, item_id) AS best FROM scores),
hit AS (SELECT *, sum(rel) OVER (PARTITION BY model, query_id ORDER BY pos) AS hits FROM placed)"""


def _scores(spark, d) -> DataFrame:
    chunks, queries = _scored(spark, d)
    rows = ranking.fused(chunks, queries).join(chunks.select(*ranking.KEYS, "label"), ranking.KEYS)
    rows = rows.select((F.col("query_id") % 3 + 1).cast("int").alias("fold"), "query_id", (F.col("document_id") * 100000 + F.col("chunk_index")).alias("item_id"), "label", F.col("bm25_score").alias("bm25"), F.col("cosine_score").alias("cosine"), F.col("rrf_score").alias("rrf"))
    return rows.unpivot(["fold", "query_id", "item_id", "label"], ["bm25", "cosine", "rrf"], "model", "score")


def _metric_sql(*exprs: tuple[str, str]) -> str:
    per = ", ".join(f"{e} AS {n}" for n, e in exprs)
    return f"WITH {_SCORES}, q AS (SELECT model, fold, query_id, {per} FROM hit GROUP BY ALL) SELECT model, {', '.join(f'round(avg({n}), 6) AS {n}' for n, _ in exprs)} FROM q GROUP BY model"


def _p(k: int) -> str:
    return f"coalesce(sum(rel) FILTER (pos <= {k}), 0) / {k}.0"


def _dcg(k: int, by: str = "pos") -> str:
    return f"coalesce(sum((2 ** label - 1) / ln(1 + {by})) FILTER ({by} <= {k} AND rel = 1), 0)"


_MAP, _MRR, _AP = "coalesce(avg(hits / pos::DOUBLE) FILTER (rel = 1), 0)", "coalesce(1.0 / min(pos) FILTER (rel = 1), 0)", "avg(hits / pos::DOUBLE)"
_NDCG = lambda k: f"CASE WHEN {_dcg(k, 'best')} > 0 THEN {_dcg(k)} / {_dcg(k, 'best')} ELSE 0 END"


def _metrics(spark, d, *names: str) -> DataFrame:
    out = metrics.averaged(metrics.per_query(_scores(spark, d)), ("model",)).drop("fold")
    return out.select("model", *[F.round(n, 6).alias(n) for n in names])


@query(_metric_sql(("map", _MAP)))
def metric_map(spark, d):
    return _metrics(spark, d, "map")


@query(_metric_sql(("mrr", _MRR)))
def metric_mrr(spark, d):
    return _metrics(spark, d, "mrr")


@query(_metric_sql(*[(f"precision_at_{k}", _p(k)) for k in metrics.KS]))
def precision_at_k(spark, d):
    return _metrics(spark, d, *[f"precision_at_{k}" for k in metrics.KS])


@query(_metric_sql(*[(f"dcg_at_{k}", _dcg(k)) for k in metrics.KS]))
def dcg_at_k(spark, d):
    return _metrics(spark, d, *[f"dcg_at_{k}" for k in metrics.KS])


@query(_metric_sql(*[(f"ndcg_at_{k}", _NDCG(k)) for k in metrics.KS]))
def ndcg_at_k(spark, d):
    return _metrics(spark, d, *[f"ndcg_at_{k}" for k in metrics.KS])


@query(_metric_sql(("average_precision", _AP)))
def average_precision(spark, d):
    return _metrics(spark, d, "average_precision")


_FIVE = [("map", _MAP), ("mrr", _MRR), ("precision_at_5", _p(5)), ("ndcg_at_5", _NDCG(5)), ("average_precision", _AP)]
_PER_FOLD = f"{_SCORES}, q AS (SELECT model, fold, query_id, {', '.join(f'{e} AS {n}' for n, e in _FIVE)} FROM hit GROUP BY ALL), f AS (SELECT model, fold, {', '.join(f'avg({n}) AS {n}' for n, _ in _FIVE)} FROM q GROUP BY ALL)"
_NAMES = [n for n, _ in _FIVE]


@query(f"WITH {_PER_FOLD} SELECT model, fold, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM f")
def cv_evaluation(spark, d):
    return _rounded(metrics.averaged(metrics.per_query(_scores(spark, d))).select("model", "fold", *_NAMES), 6, *_NAMES)


@query(f"WITH {_PER_FOLD} SELECT model, {', '.join(f'round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std' for n in _NAMES)} FROM f GROUP BY model")
def cv_summary(spark, d):
    out = metrics.cross_validated(metrics.averaged(metrics.per_query(_scores(spark, d))).select("model", "fold", *_NAMES))
    return _rounded(out, 6, *[f"{n}_{x}" for n in _NAMES for x in ("mean", "std")])


_MODELS = f"{_PER_FOLD}, m AS (SELECT model, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM q GROUP BY model), long AS (" + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {n} AS value FROM m" for n in _NAMES) + ")"


def _models(spark, d) -> DataFrame:
    return _metrics(spark, d, *_NAMES)


@query(f"WITH {_MODELS} SELECT * FROM m ORDER BY map DESC, model")
def model_compare(spark, d):
    return metrics.compared(_models(spark, d))


@query(f"WITH {_MODELS} SELECT metric, max(value) AS value, arg_max(model, value) AS best FROM (SELECT * FROM long ORDER BY model) GROUP BY metric")
def best_models(spark, d):
    return metrics.best_by_metric(_models(spark, d), _NAMES)


@query(f"WITH {_MODELS} SELECT model, round(avg(r), 6) AS average_rank FROM (SELECT model, rank() OVER (PARTITION BY metric ORDER BY value DESC) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM long) GROUP BY model")
def avg_model_rank(spark, d):
    return _rounded(metrics.average_ranks(_models(spark, d), _NAMES), 6, "average_rank")


# files written and read again

_FLAT = "regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')"


def _file_rows(spark, d) -> DataFrame:
    docs = b.documents(spark, d).filter("text IS NOT NULL AND text <> ''")
    return docs.select(F.col("doc_id").cast("string").alias("query_id"), F.regexp_replace("text", r"[\t\n\r]", " ").alias("chunk_text"), (F.col("doc_id") % 2).cast("string").alias("label"))


_FILE_ROWS = f"SELECT doc_id::VARCHAR AS query_id, md5({_FLAT}) AS chunk_md5, (doc_id % 2)::VARCHAR AS label FROM documents WHERE text <> ''"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.md5("chunk_text").alias("chunk_md5"), "label")


@query(_FILE_ROWS)
def tsv_quoted(spark, d):
    writers.tsv(_file_rows(spark, d), path := b.scratch(spark, "tsv"))
    return _shown(readers.tsv(spark, path, quoted=True))


@query(_FILE_ROWS)
def tsv_escaped(spark, d):
    writers.tsv(_file_rows(spark, d), path := b.scratch(spark, "tsv"), escaped=True)
    return _shown(readers.tsv(spark, path))


@query(_FILE_ROWS)
def csv_results(spark, d):
    writers.csv(_file_rows(spark, d), path := b.scratch(spark, "csv"))
    return _shown(spark.read.option("header", True).csv(path))


@query("SELECT n, n_label FROM (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_label FROM labels)")
def json_report(spark, d):
    counts = b.table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_label"))
    writers.json_report(counts, path := b.scratch(spark, "json"))
    return spark.read.schema("n long, n_label long").json(path)


@query("SELECT 'n: ' || count(*) AS line FROM labels UNION ALL SELECT 'n_label: ' || count(*) FILTER (quality = 1) FROM labels")
def text_summary(spark, d):
    counts = b.table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_label"))
    writers.text_summary(counts, path := b.scratch(spark, "text"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT item_id::VARCHAR AS document_id, md5(text) AS document_md5 FROM benchmark WHERE text <> ''")
def document_files(spark, d):
    """A folder for each name, a file in each, read as whole files by folder."""
    rows = b.queries(spark, d).filter("query_text IS NOT NULL AND query_text <> ''").select(F.col("query_id").alias("name"), F.col("query_text").alias("value"))
    rows.write.partitionBy("name").option("lineSep", "\x03").text(path := b.scratch(spark, "files"))
    files = readers.whole_files(spark, path, "parent")
    return files.select(F.regexp_replace("document_id", "^name=", "").alias("document_id"), F.md5(F.replace("document", F.lit("\x03"), F.lit(""))).alias("document_md5"))


@query(f"WITH q AS (SELECT doc_id, doc_id % {b.N_QUERIES} AS query_id, text FROM documents WHERE text <> '') SELECT query_id, md5(arg_min(text, doc_id)) AS query_md5 FROM q GROUP BY query_id")
def query_map_scan(spark, d):
    n = b.table(spark, d, "benchmark").count()
    rows = b.documents(spark, d).filter("text <> ''").select((F.col("doc_id") % n).alias("query_id"), F.col("text").alias("query_text"), "doc_id")
    return readers.query_map(rows, "doc_id").select("query_id", F.md5("query_text").alias("query_md5"))


@query("SELECT md5(b.text) AS query_md5, md5(d.text) AS chunk_md5, quality AS label FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.doc_id % (SELECT count(*) FROM benchmark)")
def standard_columns(spark, d):
    """Columns under other names, found by their synonyms."""
    rows = b.judged_documents(spark, d).join(b.queries(spark, d), "query_id").select(F.col("query_text").alias("Question"), F.col("text").alias("passage"), F.col("label").alias("rel"))
    found = schemas.resolved(rows, schemas.Resolution(schemas.PAIRS))
    return found.select(F.md5("query_text").alias("query_md5"), F.md5("chunk_text").alias("chunk_md5"), "label")


@query(f"WITH {_FOLD} SELECT query_id, document_id, label FROM folds WHERE own <> 2")
def pack_files(spark, d):
    writers.packs(pairs.expanded(_folded(spark, d), 5), path := b.scratch(spark, "packs"))
    return writers.read_pack(spark, path, 2, "train")


# cleaning


@query(f"""WITH c AS (SELECT doc_id, text, substr(text, 1, length(text) * (5 + doc_id % 6) // 10) AS t FROM documents)
  SELECT doc_id, coalesce(length(text) > 0 AND length(t) > 0 AND abs(length(t) - length(text)) / length(text)::DOUBLE <= 0.3 AND abs(len({sql_words('t')}) - len({sql_words('text')})) / nullif(len({sql_words('text')}), 0)::DOUBLE <= 0.3, false) AS passes FROM c""")
def clean_guard(spark, d):
    cut = F.expr("substr(text, 1, cast(length(text) * (5 + doc_id % 6) div 10 as int))")
    return b.documents(spark, d).select("doc_id", cleaning.guard_passes(F.col("text"), cut).alias("passes"))


def _sql_clean(x: str) -> str:
    """The cleaning rules in their order; an acronym's period is found twice over, as RE2 can't look ahead."""
    known, mark, edge = "|".join(cleaning.ACRONYMS), cleaning.MARK, r"(^|[^\p{L}\p{M}\p{N}_])"
    out = sql_rules(f"coalesce({x}, '')", cleaning.HEADERS + cleaning.TAGS + cleaning.TRANSCRIPT + cleaning.BRACKETS)
    acronym = (rf"{edge}({known})\.\s+([A-Za-z])", f"$1$2{mark} $3")
    out = sql_rules(out, [acronym, acronym, (rf"{edge}({known})\.$", f"$1$2{mark} "), *cleaning.BOUNDARIES])
    periods = [(p.replace(r"\b", edge, 1), "$1" + to.replace("$1", "$2")) if p.startswith(r"\b") else (p, to) for p, to in cleaning.PERIODS]
    return sql_strip(f"replace({sql_rules(sql_strip(out), periods)}, '{mark}', '.')")


def _sql_interview(x: str) -> str:
    """Where speakers begin is marked first, as RE2 can't look ahead."""
    first, second, *rest = cleaning.INTERVIEW
    marked = sql_rules(sql_rules(f"coalesce({x}, '')", [first]), [(r"(\s+\([^)]+\))", "\x02$1"), (r"\(([^)]+)\)\s+([A-Z]\x02?[^.!?\x02][^.!?\x02]*?)(?:\x02|$)", second[1]), (r"\x02", "")])
    out = sql_rules(marked, rest)
    closed = """CASE WHEN (length(o) - length(replace(o, '"', ''))) % 2 = 1 THEN o || '"' ELSE o END"""
    return f"list_transform([{out}], lambda o: {sql_strip(sql_collapse(closed))})[1]"


def _sql_guarded(x: str, y: str) -> str:
    near = lambda f: f"abs({f(y)} - {f(x)}) / nullif({f(x)}, 0)::DOUBLE <= 0.3"
    n_chars, n_words = (lambda t: f"length({t})"), (lambda t: f"len({sql_words(t)})")
    return f"CASE WHEN length({x}) > 0 AND length({y}) > 0 AND {near(n_chars)} AND {near(n_words)} THEN {y} ELSE {x} END"


@query(f"WITH c AS (SELECT doc_id, text, {_sql_clean('text')} AS c FROM documents) SELECT doc_id, length(c)::INT AS n_chars, md5(c) AS cleaned, md5({_sql_guarded('text', 'c')}) AS guarded FROM c")
def corpus_clean(spark, d):
    c = cleaning.corpus_clean(F.col("text"))
    return b.documents(spark, d).select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("cleaned"), F.md5(cleaning.guarded(F.col("text"), c)).alias("guarded"))


@query(f"SELECT doc_id, md5({_sql_interview('text')}) AS formatted FROM documents")
def interview_format(spark, d):
    return b.documents(spark, d).select("doc_id", F.md5(cleaning.interview_format(F.col("text"))).alias("formatted"))


@query(f"SELECT doc_id, md5({_NORMAL('text')}) AS splitter, md5({_NORMAL('text')}) AS grouped FROM documents")
def preclean(spark, d):
    """These texts have no wire headers: only white space changes."""
    return b.documents(spark, d).select("doc_id", F.md5(cleaning.splitter_preclean(F.col("text"))).alias("splitter"), F.md5(cleaning.grouping_preclean(F.col("text"))).alias("grouped"))


# boundaries and similarities

_BOUNDS = "b AS (SELECT doc_id, list_sort(list_distinct([(doc_id % 5 + 2)::INT, (doc_id % 7 + 5)::INT, 20])) AS c, list_sort(list_distinct([(doc_id % 3 + 4)::INT, (doc_id % 11 + 6)::INT, 21])) AS v FROM documents)"


@query(f"""WITH {_BOUNDS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(c, v))), ',') AS merged, array_to_string(list_sort(list_intersect(c, v)), ',') AS voted,
  array_to_string(list_filter(c, lambda x: len(list_filter(v, lambda y: abs(x - y) <= 2)) > 0), ',') AS near FROM b""")
def boundary_vote(spark, d):
    n = lambda mod, add: (F.col("doc_id") % mod + add).cast("int")
    c, v = (F.array_sort(F.array_distinct(F.array(*x))) for x in ((n(5, 2), n(7, 5), F.lit(20)), (n(3, 4), n(11, 6), F.lit(21))))
    text_of = lambda a: F.array_join(a.cast("array<string>"), ",")
    return b.documents(spark, d).select("doc_id", text_of(boundaries.merged(c, v)).alias("merged"), text_of(boundaries.voted(c, v)).alias("voted"), text_of(boundaries.near_both(c, v, 2)).alias("near"))


_UNIT = "u AS (SELECT vec_id // 20 AS doc, vec_id AS place, (vec_id // 5) % 4 AS grp, list_transform(embedding::DOUBLE[], lambda x: x / CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1e-9 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END) AS v FROM embeddings)"


def _units(spark, d) -> DataFrame:
    """Vectors as the sentences of made-up documents of twenty."""
    e = b.table(spark, d, "embeddings")
    return e.select(F.expr("vec_id div 20").alias("doc"), F.col("vec_id").alias("place"), F.expr("(vec_id div 5) % 4").alias("grp"), vectors.l2_normalized(F.col("embedding")).alias("v"))


_ADJACENT = f"{_UNIT}, a AS (SELECT doc, place, list_dot_product(v, lead(v) OVER (PARTITION BY doc ORDER BY place)) AS s FROM u)"


@query(f"WITH {_ADJACENT} SELECT doc, place, round(s, 6) AS similarity FROM a WHERE s IS NOT NULL")
def adjacent_similarity(spark, d):
    return _rounded(boundaries.adjacent(_units(spark, d), "doc", "place", "v"), 6, "similarity")


@query(f"WITH {_ADJACENT}, z AS (SELECT doc, place, (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 1e-9) AS z FROM a WHERE s IS NOT NULL WINDOW w AS (PARTITION BY doc)) SELECT doc, place, round(z, 5) AS z, round(1 / (1 + exp(-z / 0.5)), 5) AS sigmoid FROM z")
def zscore_sigmoid(spark, d):
    rows = profile.standardised(boundaries.adjacent(_units(spark, d), "doc", "place", "v"), "similarity", "doc", 0.5)
    return _rounded(rows.select("doc", "place", "z", "sigmoid"), 5, "z", "sigmoid")


@query(f"""WITH {_UNIT}, s AS (SELECT doc, grp, list_dot_product(v, lead(v) OVER (PARTITION BY doc, grp ORDER BY place)) AS s FROM u)
  SELECT doc, grp, count(*) AS n, round(avg(s), 4) AS sim_mean, round(min(s), 4) AS sim_min, round(max(s), 4) AS sim_max, round(stddev_pop(s), 4) AS sim_std FROM s GROUP BY ALL""")
def chunk_similarity(spark, d):
    return boundaries.group_similarity(_units(spark, d), "doc", "place", "grp", "v")


@query(f"""WITH {_UNIT}, s AS (SELECT x.doc, list_dot_product(x.v, y.v) AS s FROM u x JOIN u y ON x.doc = y.doc AND x.place < y.place)
  SELECT doc, count(*) AS n, round(min(s), 6) AS min, round(max(s), 6) AS max, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, {', '.join(f'round(quantile_cont(s, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90, 95))} FROM s WHERE s < 1 - 1e-5 GROUP BY doc""")
def similarity_distribution(spark, d):
    out = boundaries.similarity_distribution(_units(spark, d), "doc", "place", "v")
    return _rounded(out, 6, "min", "max", "mean", "std", *[f"p{p}" for p in (10, 25, 50, 75, 90, 95)])


_SMOOTH = f"""{_ADJACENT}, x AS (SELECT doc, place, s, lag(s, 1, s) OVER w AS before, lead(s, 1, s) OVER w AS after, lag(s) OVER w AS b0, lead(s) OVER w AS a0, count(*) OVER (PARTITION BY doc) AS n FROM a WHERE s IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY place))"""


@query(f"""WITH {_SMOOTH} SELECT doc, place, round(CASE WHEN n < 3 THEN s ELSE list_aggregate([before, s, after], 'median') END, 6) AS median, round(CASE WHEN n < 3 THEN s ELSE (coalesce(b0, 0) + s + coalesce(a0, 0)) / 3 END, 6) AS average FROM x""")
def smoothed_series(spark, d):
    """Neighbours' similarities by centered median and by moving average."""
    rows = boundaries.adjacent(_units(spark, d), "doc", "place", "v").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "similarity"))).alias("s"))  # a document's own
    return _rounded(rows.select("doc", F.explode(contiguous.smoothed(3)("s")).alias("s")).select("doc", "s.*"), 6, "median", "average")


@query(f"""WITH {_UNIT}, e AS (SELECT doc, place, unnest(v) AS x, unnest(range(len(v))) AS k FROM u),
m AS (SELECT doc, place, k, avg(x) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l, avg(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r FROM e WINDOW w AS (PARTITION BY doc, k ORDER BY place))
SELECT doc, place, round(1 - sum(l * r) / ((sqrt(sum(l * l)) + 1e-9) * (sqrt(sum(r * r)) + 1e-9)), 6) AS gap FROM m WHERE r IS NOT NULL GROUP BY doc, place""")
def gap_series(spark, d):
    """Block means on either side of every gap."""
    rows = _units(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))  # a document's own
    return _rounded(rows.select("doc", F.explode(contiguous.gaps(4)("s")).alias("s")).select("doc", "s.*"), 6, "gap")


# triples: the first words of every sentence as extractions

_TRIPLES = f"""w AS (SELECT doc_id, list_transform({_A}, lambda s: {sql_words('s')}) AS w FROM documents),
t AS (SELECT doc_id, list_filter(flatten(list_transform(w, lambda w: [{{'subject': w[1], 'relation': w[2], 'object': w[3]}}, {{'subject': w[1], 'relation': w[2], 'object': coalesce(w[4], '')}}, {{'subject': lower(w[1]), 'relation': w[2], 'object': w[3]}}])),
  lambda x: coalesce(x.subject, '') <> '' AND coalesce(x.relation, '') <> '' AND coalesce(x.object, '') <> '') AS t FROM w)"""


def _raw_triples(spark, d) -> DataFrame:
    part = lambda c: F.struct(F.concat(F.lit(" "), c, F.lit(" ")).alias("text"))

    def items(w):
        word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
        item = lambda s, *o: F.struct(F.struct(part(s).alias("arg1"), part(word(1)).alias("rel"), F.array(*map(part, o)).alias("arg2s")).alias("extraction"))
        return F.array(item(word(0), word(2), word(3)), item(F.lower(word(0)), word(2)))

    found = F.transform(F.transform(text.sentences_profile(F.col("text")), text.words), items)
    return b.documents(spark, d).select("doc_id", "text", triples.flattened(F.to_json(F.flatten(found))).alias("t"))


@query(f"WITH {_TRIPLES} SELECT doc_id, unnest(t, recursive := true) FROM t")
def triples_flatten(spark, d):
    return _raw_triples(spark, d).select("doc_id", F.explode("t").alias("t")).select("doc_id", "t.*")


@query(f"""WITH {_TRIPLES}, e AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM t),
n AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x.subject), lower(x.relation), lower(x.object) ORDER BY i) AS n FROM e)
SELECT doc_id, x.subject, x.relation, x.object FROM n WHERE n = 1""")
def triples_dedup(spark, d):
    return _raw_triples(spark, d).select("doc_id", F.explode(triples.deduplicated(F.col("t"))).alias("t")).select("doc_id", "t.*")


@query(f"""WITH {_TRIPLES} SELECT t.doc_id, array_to_string(list_transform(t, lambda x: '(' || x.subject || '; ' || x.relation || '; ' || x.object || ')'), ' ') AS parentheses,
  nullif(array_to_string(list_transform(list_slice(t, 1, 2), lambda x: x.subject || ' ' || x.relation || ' ' || x.object || '.'), ' '), '') AS sentences,
  md5(CASE WHEN len(t) > 0 THEN d.text || ' ' || array_to_string(list_transform(t, lambda x: '(' || x.subject || '; ' || x.relation || '; ' || x.object || ')'), ' ') ELSE d.text END) AS enriched FROM t JOIN documents d USING (doc_id)""")
def triples_text(spark, d):
    t = F.col("t")
    return _raw_triples(spark, d).select("doc_id", triples.in_parentheses(t).alias("parentheses"), triples.as_sentences(t, 2).alias("sentences"), F.md5(triples.with_triples(F.col("text"), triples.in_parentheses(t))).alias("enriched"))


# chunkers in numpy: no SQL; the tests hold them against plain versions


@query()
def contiguous_chunks(spark, d):
    from ..operators.contiguous import split

    return split(b.documents(spark, d), "doc_id", "text").select("doc_id", "chunk_index", "chunk_id", "n", "sent_indices", "sim_mean", "sim_min", "sim_max", "sim_std", F.md5("chunk_text").alias("chunk_md5"))


@query()
def semantic_groups(spark, d):
    from ..operators.grouping import group

    return group(b.documents(spark, d), "doc_id", "text").select("doc_id", "chunk_index", "chunk_id", "n", "sent_indices", "method", "exemplar", "exemplar_centrality", "sim_mean", F.md5("chunk_text").alias("chunk_md5"))


@query()
def signal_series(spark, d):
    from ..operators.contiguous import signal_series as series

    return _rounded(series(b.documents(spark, d), "doc_id", "text"), 6, "similarity", "gap")


@query()
def diameter_split(spark, d):
    from ..operators.contiguous import diameter_split as cut

    out = cut(b.all_chunks(spark, d, 2000), 0.7)
    return out.select("doc_id", "chunk_id", F.md5("chunk_text").alias("chunk_md5"))


@query(f"""SELECT doc_id, doc_id || '_cluster0' AS chunk_id, '0,' || len({_C}) AS sent_indices, len({_C})::INT AS n_sent, length(text) / 8.0 AS sim_mean, NULL::DOUBLE AS sim_min, 0.5::DOUBLE AS sim_max, 0.25::DOUBLE AS sim_std,
  (doc_id % 5)::INT AS anchor, length(text) / 16.0 AS anchor_centrality FROM documents""")
def chunk_map(spark, d):
    """A chunk's metadata written as JSON and read as columns; what is missing is null."""
    n, size = F.size(text.sentences_strict(F.col("text"))), F.length("text")
    meta = {
        "chunk_id": F.concat(F.col("doc_id").cast("string"), F.lit("_cluster0")),
        "sent_indices": F.concat(F.lit("0,"), n.cast("string")),
        "n": n,
        "sim_mean": size / 8,
        "sim_max": F.lit(0.5),
        "sim_std": F.lit(0.25),
        "exemplar": (F.col("doc_id") % 5).cast("int"),
        "exemplar_centrality": size / 16,
    }
    return chunking.chunk_map(b.documents(spark, d).select("doc_id", F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()])).alias("meta_json")), "doc_id")


@query()
def group_map(spark, d):
    """The metadata of semantic groups as JSON and back as columns."""
    from ..operators.grouping import group

    rows = group(b.documents(spark, d), "doc_id", "text")
    meta = F.to_json(F.struct("chunk_id", "sent_indices", "n", "sim_mean", "sim_min", "sim_max", "sim_std", "exemplar", "exemplar_centrality"))
    return chunking.chunk_map(rows.select("doc_id", meta.alias("meta_json")), "doc_id")


@query(f"""WITH i AS (SELECT doc_id, text AS raw, {_sql_interview('text')} AS x FROM documents), c AS (SELECT doc_id, raw, {_sql_clean('x')} AS y FROM i), g AS (SELECT doc_id, {_sql_guarded('raw', 'y')} AS text FROM c),
  f AS ({b.sql_fixed("g", "doc_id")}), w AS (SELECT doc_id, chunk_index, {sql_strip("translate(chunk_text, chr(9) || chr(10) || chr(13), '   ')")} AS chunk_text FROM f)
  SELECT 'text_splitter_char_naive' AS config, doc_id, chunk_index, doc_id || '_chunk' || chunk_index AS chunk_id, md5(chunk_text) AS chunk_md5 FROM w WHERE chunk_text <> ''""")
def run_fixed(spark, d):
    """The configuration of fixed width, every chunk."""
    from . import registry

    return registry.run(b.documents(spark, d), registry.chosen("text_splitter_char_naive")).select("config", "doc_id", "chunk_index", "chunk_id", F.md5("chunk_text").alias("chunk_md5"))


@query()
def run_configs(spark, d):
    """Chunks by configuration."""
    from . import registry

    out = registry.run(b.documents(spark, d), registry.chosen())
    return out.groupBy("config").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


@query(f"""WITH {_BOUNDS}, x AS (SELECT doc_id, len(list_filter(c, lambda x: len(list_filter(v, lambda y: abs(x - y) <= 1)) > 0)) / len(c)::DOUBLE AS p, len(list_filter(v, lambda x: len(list_filter(c, lambda y: abs(x - y) <= 1)) > 0)) / len(v)::DOUBLE AS r FROM b)
  SELECT doc_id::VARCHAR AS document_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""")
def boundary_scores(spark, d):
    from ..operators.contiguous import boundary_scores as scores

    n = lambda mod, add: (F.col("doc_id") % mod + add).cast("int")
    c, v = (F.array_sort(F.array_distinct(F.array(*x))) for x in ((n(5, 2), n(7, 5), F.lit(20)), (n(3, 4), n(11, 6), F.lit(21))))
    docs = b.documents(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), c.alias("c"), v.alias("v"))
    return _rounded(scores(docs.withColumnRenamed("c", "bounds"), docs.withColumnRenamed("v", "bounds")), 6, "precision", "recall", "f1")
