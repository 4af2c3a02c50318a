"""Labelled pairs: validation, pairability, folds, sampling, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import numeric_label
from ..functions.text import normalize, word_tokens


def checked(pairs: DataFrame, min_length: int = 1) -> DataFrame:
    """Normalised query_text and chunk_text, int label, and drop_reason: bad_label, empty_text, short_text or null."""
    out = pairs.select(normalize(F.col("query_text")).alias("query_text"), normalize(F.col("chunk_text")).alias("chunk_text"), numeric_label(F.col("label")).alias("label"))
    reason = F.when(F.col("label").isNull(), "bad_label").when((F.col("query_text") == "") | (F.col("chunk_text") == ""), "empty_text").when((F.length("query_text") < min_length) | (F.length("chunk_text") < min_length), "short_text")
    return out.withColumn("drop_reason", reason)


def valid(pairs: DataFrame, min_length: int = 1) -> DataFrame:
    return checked(pairs, min_length).filter("drop_reason IS NULL").drop("drop_reason")


def pairability(pairs: DataFrame, by: str = "query_text") -> DataFrame:
    """pos, neg, total and status (pairable, only_pos, only_neg) of every query."""
    pos, neg = F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)
    out = pairs.groupBy(by).agg(pos.alias("pos"), neg.alias("neg"), F.count("*").alias("total"))
    return out.withColumn("status", F.when((F.col("pos") > 0) & (F.col("neg") > 0), "pairable").when(F.col("pos") > 0, "only_pos").otherwise("only_neg"))


def pairable_only(pairs: DataFrame, by: str = "query_text") -> DataFrame:
    """Without the pairs of queries that lack a class."""
    return pairs.join(pairability(pairs, by).filter("status = 'pairable'").select(by), by, "left_semi")


def validation_report(pairs: DataFrame, min_length: int = 1, drop_unpairable: bool = False) -> DataFrame:
    """One row of ten counters."""
    rows = checked(pairs, min_length)
    by_query = pairability(rows.filter("drop_reason IS NULL"))
    status = lambda s: F.count_if(F.col("status") == s)
    queries = by_query.agg(F.count("*").alias("queries"), status("pairable").alias("pairable"), status("only_pos").alias("only_pos"), status("only_neg").alias("only_neg"), F.coalesce(F.sum(F.when(F.col("status") != "pairable", F.col("total"))), F.lit(0)).cast("long").alias("unpairable_rows"))
    reason = lambda r: F.count_if(F.col("drop_reason") == r)
    counts = rows.agg(F.count("*").alias("rows_in"), F.count_if(F.col("drop_reason").isNull()).alias("valid"), reason("bad_label").alias("bad_label"), reason("empty_text").alias("empty_text"), reason("short_text").alias("short_text"))
    kept = F.col("valid") - F.when(F.lit(drop_unpairable), F.col("unpairable_rows")).otherwise(F.lit(0))
    return counts.join(queries).select("rows_in", kept.alias("rows_kept"), "bad_label", "empty_text", "short_text", "queries", "pairable", "only_pos", "only_neg", "unpairable_rows")  # one row each


def distinct_texts(pairs: DataFrame, left: str = "text_left", right: str = "text_right") -> DataFrame:
    return pairs.agg(F.countDistinct(left).alias("n_left"), F.countDistinct(right).alias("n_right"))


def shuffle_key(seed: int, *cols: str) -> Column:
    """A portable random order: md5 of the seed and the row's columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def folded(rows: DataFrame, key: Column, folds: int, ties: list[str], digits: int = 3) -> DataFrame:
    """fold (1 to ``folds``) for every row: contiguous in the order of ``key``, the first n mod folds one larger.

    Ranks are taken within leading digits of the key and shifted by the counts of those before, so no task orders all rows.
    """
    keyed = rows.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, digits))
    parts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))  # 16 ** digits rows at most
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key", *ties)) - 1 + F.col("_before")
    keyed = keyed.join(F.broadcast(parts), "_part").withColumn("_place", place)
    size, larger = F.floor(F.col("_total") / folds), F.col("_total") % folds
    edge = larger * (size + 1)
    fold = F.when(F.col("_place") < edge, F.floor(F.col("_place") / (size + 1))).otherwise(larger + F.floor((F.col("_place") - edge) / F.greatest(size, F.lit(1))))
    return keyed.withColumn("fold", (fold + 1).cast("int")).drop("_key", "_part", "_before", "_total", "_place")


def expanded(rows: DataFrame, folds: int) -> DataFrame:
    """Each row once for every fold: test in its own, train in the others."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    out = rows.withColumnRenamed("fold", "_own").withColumn("fold", numbers)
    return out.withColumn("split", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def sampled_pairs(rows: DataFrame, id_col: str, num_neg: int = 1, num_dup: int = 1, seed: int = 42, by: str = "query_id") -> DataFrame:
    """For every row, ``num_dup`` times, ``num_neg`` of its query's rows with a smaller label, whichever; fewer where there are fewer.

    A query's rows have numbers by label, then md5; those with smaller labels are the first so many, and a row takes the numbers that follow its own md5, round about, so neither
    side is paired with all of the other.
    """
    n = lambda c: F.conv(F.substring(c, 1, 7), 16, 10).cast("long")
    low = rows.select(by, F.col(id_col).alias("neg_id"), F.col("label").alias("neg_label"))
    low = low.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy("neg_label", shuffle_key(seed, by, "neg_id"), "neg_id")) - 1)
    levels = rows.groupBy(by, F.col("label").alias("pos_label")).agg(F.count("*").alias("_n"))  # a query has few labels
    smaller = F.sum("_n").over(Window.partitionBy(by).orderBy("pos_label").rowsBetween(Window.unboundedPreceding, -1))
    high = rows.select(by, F.col(id_col).alias("pos_id"), F.col("label").alias("pos_label"))
    drawn = high.join(levels.withColumn("_n", smaller).filter("_n > 0"), [by, "pos_label"]).withColumn("dup", F.explode(F.sequence(F.lit(0), F.lit(num_dup - 1))))
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(num_neg), F.col("_n").cast("int")) - 1)))
    first = n(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), F.col("pos_id").cast("string"), F.col("dup").cast("string"))))
    drawn = drawn.withColumn("_nth", ((first + F.col("draw")) % F.col("_n")).cast("int"))
    return drawn.join(low, [by, "_nth"]).select(by, "pos_id", "neg_id", "dup", "draw")


def vocabulary(texts: DataFrame, text: str, min_documents: int = 5) -> DataFrame:
    """token, n_documents of tokens that so many texts have at least."""
    tokens = texts.select(F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents)


def padded(ids: Column, length: int, pad: int = 0, pre: bool = True) -> Column:
    """The first ``length`` ids, filled up with ``pad`` in front (pre) or behind."""
    some = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), length - F.size(some))
    return F.concat(fill, some) if pre else F.concat(some, fill)
