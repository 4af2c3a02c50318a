"""What several operators share: the folder all executors see, cut lineage, keys, the tokenizer's place."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; ``name`` may be a path already."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def named(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def unused(name: str, names: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {x.lower() for x in names}:
        name += "_"
    return name


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/chunklore-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    """The JVM's file system of a path, and the path."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def exists(spark: SparkSession, path: str) -> bool:
    system, of = _place(spark, path)
    return system.exists(of)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, lost executors cost no recomputation. The table goes when the application ends, or with drop()."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/chunklore/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, of = _place(spark, path)
    system.deleteOnExit(of)
    # the shuffle files behind it go with their plan: now, not when the driver next happens to run out of memory
    del df
    gc.collect()
    spark.range(1).collect()  # Spark's listeners hold the last query that ended: now it is this one
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    _tables[out] = path
    return out


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` as written(), compressed more, in buckets by a column: what is grouped or joined by it in so many partitions needs no shuffle. A catalog knows buckets alone, so the table is entered there and taken out
    again at once; its files stay."""
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/chunklore/{name}-{uuid.uuid4().hex}", f"`chunklore_{uuid.uuid4().hex}`"
    system, of = _place(spark, path)
    system.deleteOnExit(of)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    _tables[out] = path
    return out


_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(*tables: DataFrame) -> None:
    """Deletes written() tables that no later plan reads; others are left alone."""
    for df in tables:
        if path := _tables.pop(df, None):
            system, of = _place(df.sparkSession, path)
            system.delete(of, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_text(docs: DataFrame, id_col: str, text_col: str, out_text: str = "text") -> DataFrame:
    """Just (doc_id, text), null text as empty; other columns, whatever their names, are left behind."""
    return docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias(out_text))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out."""
    of = named(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(of.cast("string").cast("binary")) % 5 == 0, F.lit(False))
