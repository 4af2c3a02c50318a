"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, each with its place in a sequence of at most 4096 tokens."""
    from . import packing

    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(digests)


def op2_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through a cache that starts empty: so the query's work is the whole table's."""
    from . import tokencounts
    from .common import shared_dir

    cache = f"{shared_dir(spark)}/chunklore/token-counts-{uuid.uuid4().hex}"
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), cache)


def op3_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from . import linecrf

    return linecrf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed as repeated chunks, and the digest of what stays."""
    from . import linededup

    out = linededup.without_repeated_chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
chosen AS (
  SELECT *, (h + 31337 * lag(h, 1, 0) OVER (PARTITION BY doc_id ORDER BY k)) % 2147483647 % 4 <> 0 AS hit FROM full_lines),
spans AS (
  SELECT a.doc_id, a.i AS place, coalesce(min(b.i) FILTER (b.hit), max(b.i)) AS last
  FROM chosen a JOIN chosen b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 7 GROUP BY ALL),
chunks AS (
  SELECT s.doc_id, place, last, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM spans s JOIN lines l ON s.doc_id = l.doc_id AND l.i BETWEEN place AND last GROUP BY ALL),
placed AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, first_value(place) OVER w AS first_place
  FROM chunks WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, place)),
gone AS (SELECT doc_id, place, last FROM placed WHERE NOT (doc_id = first_id AND place <= first_place + last - place)),
judged AS (
  SELECT l.*, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.i BETWEEN g.place AND g.last) AS removed FROM lines l)
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = j.doc_id) AS n_removed_chunks,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM judged j GROUP BY j.doc_id
"""

def op5_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from . import langid

    return langid.predicted_languages(table(spark, sf_dir, "documents"))


def op6_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document and the digest of those that stay."""
    from . import repeats

    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, what the vocabularies measured, and the verdict on every document."""
    from . import fertility

    return fertility.fertility_rules(table(spark, sf_dir, "documents"))


#: The rules of op8: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    from . import urlfilter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"), rules)


OP8_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM rest)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u
  JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL) b ON p.host = b.host AND p.path = b.path
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whether it holds passages of the benchmark, and the items."""
    from . import decontaminate

    found = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("benchmark_hits", lambda x: x["item_id"])
    return found.select("doc_id", "benchmark_hits", ids.alias("item_ids")).select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").alias("n_items"), "item_ids", F.array_max(F.transform("benchmark_hits", lambda x: x["similarity"])).alias("similarity"))


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pattern_packing,
        op2_digest_token_counts,
        op3_line_crf_quality,
        op4_line_chunk_dedup,
        op5_bigru_language,
        op6_suffix_array_repeats,
        op7_tokenizer_fertility,
        op8_url_rules,
        op9_benchmark_decontamination,
        op10_simhash_ball,
    )
}

ORACLE: dict[str, str] = {"op4_line_chunk_dedup": OP4_SQL, "op8_url_rules": OP8_SQL}
