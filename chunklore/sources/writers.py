"""DataFrames to files. Parquet between our own steps; the text formats for others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, escaped: bool = False, mode: str = "errorifexists") -> None:
    """Tab-separated with a header; quotes are doubled. escaped: nothing is quoted, a backslash stands before what would end a field."""
    writer = lambda d: d.write.mode(mode).option("sep", "\t").option("header", True)
    if not escaped:
        writer(df).option("escape", '"').csv(path)
        return
    text = {c: F.regexp_replace(c, r"([\\\t\n\r])", r"\\$1") for c, t in df.dtypes if t == "string"}
    writer(df.withColumns(text)).option("quote", "").csv(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def json_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row as one JSON text."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")).coalesce(1).write.mode(mode).text(path)


def text_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``name: value`` lines of a few rows."""
    line = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    df.select(line.alias("value")).coalesce(1).write.mode(mode).text(path)


def packs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Folds, each with its train and test rows, in folders that a reader can pick from by name."""
    df.write.mode(mode).partitionBy("fold", "split").parquet(path)


def read_pack(spark, path: str, fold: int, split: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("fold") == fold) & (F.col("split") == split)).drop("fold", "split")
