"""Ranking metrics from a table of scores: model, fold, query_id, item_id, label, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def per_query(scores: DataFrame, keys: tuple[str, ...] = ("model", "fold", "query_id"), ks: tuple[int, ...] = KS) -> DataFrame:
    """map, mrr, average_precision and precision_at_k, dcg_at_k, ndcg_at_k of every query; 0 where a metric isn't defined. Ties go by item_id. One shuffle: both orders and all sums are by the query."""
    by = Window.partitionBy(*keys)
    order = by.orderBy(F.desc("score"), "item_id")
    relevant = (F.col("label") > 0).cast("int")
    rows = scores.withColumn("pos", F.row_number().over(order)).withColumn("rel", relevant)
    rows = rows.withColumn("hits", F.sum("rel").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("best", F.row_number().over(by.orderBy(F.desc("label"), "item_id")))
    gain = F.pow(F.lit(2.0), F.col("label").cast("double")) - 1
    aggs: list[Column] = [
        F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("hits") / F.col("pos"))), F.lit(0.0)).alias("map"),
        F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("pos"))), F.lit(0.0)).alias("mrr"),
        F.avg(F.col("hits") / F.col("pos")).alias("average_precision"),
    ]
    zero = F.lit(0.0)
    for k in ks:
        within, ideal = F.col("pos") <= k, F.col("best") <= k
        dcg = F.sum(F.when(within & (F.col("rel") == 1), gain / F.log(1.0 + F.col("pos"))).otherwise(zero))
        best = F.sum(F.when(ideal & (F.col("rel") == 1), gain / F.log(1.0 + F.col("best"))).otherwise(zero))
        aggs += [(F.sum(F.when(within, F.col("rel")).otherwise(0)) / F.lit(float(k))).alias(f"precision_at_{k}"), dcg.alias(f"dcg_at_{k}"), F.coalesce(F.try_divide(dcg, best), zero).alias(f"ndcg_at_{k}")]
    return rows.groupBy(*keys).agg(*aggs)


def averaged(queries: DataFrame, keys: tuple[str, ...] = ("model", "fold")) -> DataFrame:
    names = [c for c in queries.columns if c not in (*keys, "query_id")]
    return queries.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def cross_validated(folds: DataFrame, key: str = "model") -> DataFrame:
    """Mean and population deviation over the folds, of every metric."""
    names = [c for c in folds.columns if c not in (key, "fold")]
    return folds.groupBy(key).agg(*[a for c in names for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def long_form(models: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """model, metric, value."""
    return models.unpivot([key], metrics, "metric", "value")


def best_by_metric(models: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """The best model of each metric; of equals the first by name."""
    rows = long_form(models, metrics, key)
    return rows.groupBy("metric").agg(F.max("value").alias("value"), F.min_by(key, F.struct(-F.col("value"), F.col(key))).alias("best"))


def average_ranks(models: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """Mean over the metrics of each model's rank, the largest value first; equals share the mean of their ranks."""
    by = Window.partitionBy("metric")
    rank = F.rank().over(by.orderBy(F.desc("value"))) + (F.count("*").over(Window.partitionBy("metric", "value")) - 1) / 2
    return long_form(models, metrics, key).withColumn("r", rank).groupBy(key).agg(F.avg("r").alias("average_rank"))


def compared(models: DataFrame, by: str = "map", key: str = "model") -> DataFrame:
    """A row for each model, the best first."""
    return models.orderBy(F.desc(by), key)
