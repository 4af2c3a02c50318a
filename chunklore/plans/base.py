"""The inputs of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking

SIZE = 600


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Text functions cost far more than reading: a table of few splits (one file of one row group can't be split) is dealt by id, any other is read as it lies."""
    docs, cores = table(spark, d, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= 2 * cores else docs.repartition(cores, "doc_id")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in ``spark.checkpoint.dir``, or on one machine in its own temporary folder. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/chunklore-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/queries/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def qrels(spark: SparkSession, d: str, label: Column | None = None, unknown: int = 0) -> DataFrame:
    """Labels as judgements: every document belongs to one query, and so many queries beside the known ones have documents too."""
    n = table(spark, d, "benchmark").count() + unknown
    return table(spark, d, "labels").select((F.col("doc_id") % n).alias("query_id"), F.col("doc_id").alias("document_id"), (F.col("quality") if label is None else label).alias("label"))


def wide_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of five unknown queries too."""
    return qrels(spark, d, unknown=5)


def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumnRenamed("doc_id", "document_id")
    return qrels(spark, d).join(docs, "document_id")


def all_chunks(spark: SparkSession, d: str, size: int = SIZE, overlap: int = 0) -> DataFrame:
    return chunking.chunked(documents(spark, d), chunking.fixed_width(F.col("text"), F.col("doc_id"), size, overlap), "doc_id")


def judged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """query_id, document_id, label, chunk_index, chunk_text of the judged documents."""
    rows = judged_documents(spark, d)
    return chunking.chunked(rows, chunking.fixed_width(F.col("text"), F.col("document_id"), SIZE), "query_id", "document_id", "label").drop("chunk_id", "start", "end")


# SQL of the same

BLANK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{M}\p{N}_]"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{BLANK}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}+')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{BLANK}+', ' ', 'g')"


def sql_full(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_split_after(x: str, marks: str, before: str = "") -> str:
    """Cut at blanks after marks: RE2 looks neither back nor ahead, so cuts are marked first."""
    if before:
        return f"string_split(regexp_replace({x}, '([{marks}]){BLANK}+({before})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"string_split(regexp_replace({x}, '([{marks}]){BLANK}+', '\\1' || chr(1), 'g'), chr(1))"


def sql_profile_sentences(x: str) -> str:
    return sql_full(sql_split_after(sql_collapse(x), ".!?"))


def sql_ended(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '[.!?]$') THEN {s} ELSE {s} || '.' END"


def sql_strict_sentences(x: str) -> str:
    parts = sql_full(sql_split_after(sql_strip(sql_collapse(x)), ".!?", "[A-Z]"))
    return f"list_transform(list_filter({parts}, lambda s: length(s) >= 10), lambda s: {sql_ended('s')})"


def sql_rules(x: str, rules: list[tuple[str, str]]) -> str:
    """The rules in RE2's dialect: classes of Unicode spelled out, $1 as \\1."""
    for pattern, to in rules:
        out, inside, k = "", False, 0
        while k < len(pattern):
            c, two = pattern[k], pattern[k : k + 2]
            if two in (r"\s", r"\w", r"\d"):
                of = {"s": r"\s\x0B\x85\p{Z}", "w": r"\p{L}\p{M}\p{N}_", "d": r"\p{Nd}"}[two[1]]
                out, k = out + (of if inside else f"[{of}]"), k + 2
            elif c == "\\":
                out, k = out + two, k + 2
            else:
                inside = c == "[" or inside and c != "]"
                out, k = out + c, k + 1
        new = re.sub(r"\$(\d)", r"\\\1", to)
        quoted = lambda t: "'" + t.replace("'", "''") + "'"
        x = f"regexp_replace({x}, {quoted(out)}, {quoted(new)}, 'g')"
    return x


def sql_fixed(source: str, cols: str, size: int = SIZE, overlap: int = 0) -> str:
    step = size - max(0, min(overlap, size - 1))
    return f"""SELECT {cols}, i::INT AS chunk_index, substr(text, (i * {step} + 1)::BIGINT, {size}) AS chunk_text
  FROM (SELECT *, unnest(range(greatest(1, ceil((length(text) - {size}) / {step}.0)::BIGINT + 1))) AS i FROM {source} WHERE length(text) > 0)"""


N_QUERIES = "(SELECT count(*) FROM benchmark)"
QRELS = f"SELECT doc_id % {N_QUERIES} AS query_id, doc_id AS document_id, quality AS label FROM labels"
WIDE_QRELS = f"SELECT doc_id % ({N_QUERIES} + 5) AS query_id, doc_id AS document_id, quality AS label FROM labels"
JUDGED_CHUNKS = f"""queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
qrels AS ({QRELS}),
judged AS (SELECT q.query_id, q.document_id, q.label, d.text FROM qrels q JOIN documents d ON d.doc_id = q.document_id),
chunks AS ({sql_fixed("judged", "query_id, document_id, label")})"""
BM25 = f"""{JUDGED_CHUNKS},
sized AS (SELECT query_id, document_id, chunk_index, {sql_words("lower(chunk_text)")} AS tokens FROM chunks),
tf AS (SELECT query_id, document_id, chunk_index, dl, token, count(*) AS f FROM (SELECT *, len(tokens) AS dl, unnest(tokens) AS token FROM sized) GROUP BY ALL),
corpus AS (SELECT query_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM sized GROUP BY query_id),
df AS (SELECT query_id, token, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN corpus USING (query_id)),
weights AS (SELECT query_id, token, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({sql_words("lower(query_text)")}) AS token FROM queries) GROUP BY ALL),
matched AS (
  SELECT t.query_id, document_id, chunk_index, sum(qf * idf * (f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS s
  FROM tf t JOIN weights w ON w.query_id = t.query_id AND w.token = t.token JOIN asked a ON a.query_id = t.query_id AND a.token = t.token GROUP BY ALL),
bm25 AS (
  SELECT c.query_id, c.document_id, c.chunk_index, round(greatest(coalesce(s, 0), 0), 9)::DOUBLE AS bm25_score
  FROM chunks c LEFT JOIN matched m ON m.query_id = c.query_id AND m.document_id = c.document_id AND m.chunk_index = c.chunk_index)"""


def sql_bucket(token: str) -> str:
    return f"(('0x' || substr(md5({token}), 1, 4))::INT % 64)"


RANKED = f"""{BM25},
cv AS (SELECT query_id, document_id, chunk_index, {sql_bucket("token")} AS bucket, count(*)::DOUBLE AS v FROM (SELECT query_id, document_id, chunk_index, unnest(tokens) AS token FROM sized) GROUP BY ALL),
qv AS (SELECT query_id, {sql_bucket("token")} AS bucket, count(*)::DOUBLE AS q FROM (SELECT query_id, unnest({sql_words("lower(query_text)")}) AS token FROM queries) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM qv GROUP BY ALL),
dots AS (SELECT cv.query_id, document_id, chunk_index, sum(v * coalesce(q, 0)) AS dot, sqrt(sum(v * v)) AS cn FROM cv LEFT JOIN qv ON qv.query_id = cv.query_id AND qv.bucket = cv.bucket GROUP BY ALL),
cosines AS (
  SELECT c.query_id, c.document_id, c.chunk_index, round(CASE WHEN coalesce(cn * qn, 0) > 0 THEN dot / (cn * qn) ELSE 0 END, 9)::DOUBLE AS cosine_score
  FROM chunks c LEFT JOIN dots d ON d.query_id = c.query_id AND d.document_id = c.document_id AND d.chunk_index = c.chunk_index LEFT JOIN qn ON qn.query_id = c.query_id),
both_scores AS (SELECT * FROM bm25 JOIN cosines USING (query_id, document_id, chunk_index)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, document_id, chunk_index) AS r1,
    row_number() OVER (PARTITION BY query_id ORDER BY cosine_score DESC, document_id, chunk_index) AS r2 FROM both_scores),
fused AS (SELECT query_id, document_id, chunk_index, bm25_score, cosine_score, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9)::DOUBLE AS rrf_score FROM ranks),
cuts AS (
  SELECT query_id, round(quantile_cont(rrf_score, 0.8), 12) AS hi, round(quantile_cont(rrf_score, 0.2), 12) AS lo
  FROM fused GROUP BY query_id HAVING count(*) >= 2),
labelled AS (
  SELECT f.*, (rrf_score >= hi)::INT AS label FROM fused f JOIN cuts USING (query_id) WHERE rrf_score >= hi OR rrf_score <= lo)"""
