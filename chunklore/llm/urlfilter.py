"""URL rules by hash prefixes, DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions; these meet the rules in an equi-join on the first 32 bits of
their digests, full digests confirm, and the longest rule that fits decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _prefixed(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, 8), digest


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that decides, else null), verdict.

    rules: host (lower case), path (empty, or from its ``/`` on), verdict. A rule fits its host and all subdomains where the path starts with the
    rule's path. The longest rule wins, host and path counted together; then the longer host; then ``block``.
    Null URLs and those without ``://`` have an empty host and path. Where no rule fits, ``default`` holds. Null ids stay null, repeated rows each
    give a row, other columns are ignored, empty tables give no rows (no rules: ``default`` everywhere).
    """
    spark = pages.sparkSession
    short, digest = _prefixed(F.concat("host", "path"))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    # as many as the rules have distinct path lengths, which URL lengths bound
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    # two verdicts for one rule: the stricter one; at most a row for each rule, so the side that grows is the URLs'
    rules = rules.groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict")).select(short.alias("short"), digest.alias("digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    parts = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col].cast("string")).alias("host"), path_of(pages[url_col].cast("string")).alias("path"))
    distinct = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    expanded = distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", F.explode("prefixes").alias("prefix"), "suffix")
    expanded = expanded.withColumn("expression", F.concat("suffix", "prefix"))
    short, digest = _prefixed(F.col("expression"))
    met = expanded.select("host", "path", short.alias("short"), digest.alias("full")).join(rules, "short").filter(F.col("full") == F.col("digest"))
    best = F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("best")
    decided = written(met.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    out = parts.join(decided, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
