"""Collections as DataFrames. Every reader takes anything that Spark can read: a path, a pattern or several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normalize

TOPICS = "query_id string, query_text string"


def whole_files(spark: SparkSession, path: str, named: str = "file") -> DataFrame:
    """document_id (the name of the file, or with named="parent" of its folder) and its text."""
    place = F.split("_metadata.file_path", "/")
    return spark.read.text(path, wholetext=True).select(F.element_at(place, -1 if named == "file" else -2).alias("document_id"), F.col("value").alias("document"))


def parsed_topics(files: DataFrame, text_col: str = "value", use_title: bool = True, order: str | None = None) -> DataFrame:
    """<top> blocks to query_id and query_text: description, full stop, narrative.

    With use_title the title stands for a description that is missing, the narrative stands alone where both are, and blocks without text are left out; without it the title is never
    read, so that a missing part leaves the full stop. Blocks without number are left out. Of blocks with one number the last counts, by ``order`` (a column of ``files``; as they lie, if none) and place.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    block = files.select(at.alias("file"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<top>(.*?)</top>"), F.lit(1))).alias("place", "b"))
    if use_title:  # a block that wasn't closed ends where the next one begins
        block = block.withColumn("b", F.element_at(F.split("b", "<top>"), -1))
    part = lambda p: normalize(F.regexp_extract("b", p, 1))
    title, desc, narr = part(r"(?s)<title>\s*(.*?)(?=<desc>|<narr>|\z)"), part(r"(?s)<desc>\s*Description:(.*?)(?=<narr>|\z)"), part(r"(?s)<narr>\s*Narrative:(.*)")
    out = block.select("file", "place", F.regexp_extract("b", r"<num>\s*Number:\s*(\d+)", 1).alias("query_id"), title.alias("title"), desc.alias("desc"), narr.alias("narr"))
    joined = lambda a: F.concat(F.col(a), F.lit(". "), F.col("narr"))
    text = F.when(F.col("desc") != "", joined("desc")).when(F.col("title") != "", joined("title")).otherwise(F.col("narr")) if use_title else joined("desc")
    out = out.select("file", "place", "query_id", normalize(text).alias("query_text")).filter("query_id <> '' AND query_text <> ''")
    return out.groupBy("query_id").agg(F.max_by("query_text", F.struct("file", "place")).alias("query_text"))


def topics(spark: SparkSession, path: str, use_title: bool = True) -> DataFrame:
    """Of several files, later names count as later."""
    return parsed_topics(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path")), "value", use_title, "file_path")


def parsed_qrels(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of exactly four fields: query_id, one that is ignored, document_id, label. Columns but ``col`` pass through."""
    f = F.split(F.trim(F.regexp_replace(F.col(col), r"(?U)\s+", " ")), " ")
    rest = [c for c in lines.columns if c != col]
    return lines.select(*rest, f.alias("f")).filter(F.size("f") == 4).select(*rest, F.col("f")[0].alias("query_id"), F.col("f")[2].alias("document_id"), F.col("f")[3].alias("label"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """With line, the order of the file's lines (rising within a file)."""
    return parsed_qrels(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def tsv(spark: SparkSession, path: str, quoted: bool = False, schema: str | None = None) -> DataFrame:
    """Tab-separated with a header, all text; without quoting a quote is a character. Fields that a line lacks are null; lines with more fields than the header are dropped (an empty one at the
    end doesn't count)."""
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("quote", '"' if quoted else "").option("escape", '"' if quoted else "\\")
    fields = StructType.fromDDL(schema) if schema else StructType([StructField(c, StringType()) for c in reader.csv(path).columns])
    beyond = "beyond"
    while beyond in fields.names:
        beyond += "_"
    # a column that only lines longer than the header have
    rows = reader.schema(StructType([*fields.fields, StructField(beyond, StringType())])).csv(path)
    return rows.filter(F.col(beyond).isNull()).drop(beyond)


def parsed_pairs(lines: DataFrame, strict: bool = False, col: str = "value") -> DataFrame:
    """Raw lines to query_id, chunk_text and label: first field, last field, and all between joined again by tabs. Fewer than three fields: left out; with strict more than
    three too. The header line, if any, is left out."""
    f = F.split(F.col(col), "\t")
    out = lines.select(f.alias("f")).filter(F.size("f") == 3 if strict else F.size("f") >= 3)
    out = out.select(F.trim(F.col("f")[0]).alias("query_id"), F.array_join(F.slice("f", F.lit(2), F.size("f") - 2), "\t").alias("chunk_text"), F.trim(F.element_at("f", -1)).alias("label"))
    return out.filter("query_id <> 'query_id'")


def query_map(rows: DataFrame, order: str) -> DataFrame:
    """The first text of every query_id, by ``order``."""
    return rows.groupBy("query_id").agg(F.min_by("query_text", order).alias("query_text"))


def parsed_bounds(text: Column) -> Column:
    """Sentence indices, separated by commas or newlines; anything but digits is skipped."""
    parts = F.transform(F.split(text, r"[,\n]"), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")))
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int"))


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """{document_id}.bounds files."""
    files = whole_files(spark, path)
    return files.select(F.regexp_replace("document_id", r"\.bounds$", "").alias("document_id"), parsed_bounds(F.col("document")).alias("bounds"))
