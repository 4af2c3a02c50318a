"""Repeated multi-line chunks, DataFrame functions only.

A chunk begins at every line with a word and ends at the next such line that the rolling hash over its own line and the one before chooses, three of four.
So what a chunk is depends on its own lines alone: a passage of two lines is one in any surroundings with probability 0.75, and one of
four has a chunk with 0.98, all of its lines but those after its last end. Chunks that occur again anywhere are removed after their bytes were
compared; the first occurrence, by doc_id and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, named, written

#: Base and modulus of the rolling hash: line hashes have 32 bits, so that nothing overflows 63.
BASE, MODULUS = 31337, 2147483647
#: Lines with a word that a chunk has at most: where no end was chosen it ends there.
MOST_LINES = 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _let(value: Column, of) -> Column:
    """of(value), with the value made once for all that refer to it."""
    return F.transform(F.array(value), of)[0]


def chunks_of(text: Column, divisor: int, min_lines: int) -> Column:
    """array<struct<place, last, chunk>>: first and last line (from 0) of every chunk of ``min_lines`` lines with words or more, and its text, lines without words between them included."""

    def cut(lines: Column, full: Column) -> Column:
        hashes = F.transform(full, lambda i: F.conv(F.substring(F.md5(F.get(lines, i)), 1, 8), 16, 10).cast("long"))

        def spans(h: Column) -> Column:
            last = F.size(h) - 1
            chosen = F.transform(F.sequence(F.lit(0), last), lambda i: (F.get(h, i) + BASE * F.coalesce(F.get(h, i - 1), F.lit(0).cast("long"))) % MODULUS % divisor != 0)

            def ends(chosen: Column) -> Column:
                def end(k: Column) -> Column:
                    return F.coalesce(*[F.when(F.get(chosen, k + step), k + step) for step in range(min_lines - 1, MOST_LINES)], F.least(k + (MOST_LINES - 1), last))

                return F.transform(F.sequence(F.lit(0), last - (min_lines - 1)), lambda k: F.struct(F.get(full, k).alias("place"), F.get(full, end(k)).alias("last")))

            return _let(chosen, ends)

        text_of = lambda s: F.array_join(F.slice(lines, s["place"] + 1, s["last"] - s["place"] + 1), "\n")
        return F.transform(_let(hashes, spans), lambda s: F.struct(s["place"].alias("place"), s["last"].alias("last"), text_of(s).alias("chunk")))

    def with_full(lines: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\S"))
        none = F.array().cast("array<struct<place:int,last:int,chunk:string>>")
        return _let(full, lambda f: F.when(F.size(f) < min_lines, none).otherwise(cut(lines, f)))

    return _let(_lines(text), with_full)


def without_repeated_chunks(docs: DataFrame, divisor: int = 4, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without chunks seen before, and n_lines, n_removed_lines, n_removed_chunks.

    Order of occurrence: doc_id (null last), then the text's hash, then the place; an occurrence that overlaps the first one in its own text stays too. Judged on the input, so a
    line goes if any chunk over it does. Repeated rows (same id, same text) count as one document and share its decisions. Null text stays null and has no lines; empty text is one
    empty line. Lines without a word are no lines of the ``min_lines`` that a chunk must have. A text of nothing but removed chunks becomes empty. Added columns replace columns
    of those names; others, whatever their names, pass through. Very long texts are cut like others: chunks have MOST_LINES lines with words at most. An empty table gives no rows.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[named(c) for c in own]).alias("row"), named(id_col).alias("id"), F.xxhash64(named(text_col).cast("string")).alias("mark"))
    body = F.col("row").getField(text_col).cast("string")
    listed = rows.select("id", "mark", F.explode(chunks_of(body, divisor, min_lines)).alias("c"))
    listed = written(listed.select("id", "mark", "c.place", "c.last", F.unhex(F.md5("c.chunk")).alias("digest")), "line-chunks")
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "place")
    again = listed.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("final")).filter("first <> final").select("digest", "first")
    again = written(again, "repeated-chunks")
    own_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("place") <= F.col("first.place") + F.col("last") - F.col("place"))
    marks = listed.join(again, "digest").select("id", "mark", F.struct("place", "last", "digest", own_first.alias("stays")).alias("m"))
    per_doc = marks.groupBy("id", "mark").agg(F.collect_set("m").alias("marks"))  # no longer than the document
    joined = rows.alias("r").join(per_doc.alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.mark") == F.col("p.mark")), "left").select("row", "marks")
    joined = written(joined, "marked-documents")
    drop(listed, again)
    # byte comparison: of all chunks of one digest the smallest and the largest must be the same bytes
    pieces = _let(_lines(body), lambda x: F.transform("marks", lambda m: F.struct(m["digest"].alias("digest"), F.array_join(F.slice(x, m["place"] + 1, m["last"] - m["place"] + 1), "\n").alias("chunk"))))
    candidates = joined.filter("marks IS NOT NULL").select(F.explode(pieces).alias("c")).select("c.*")
    bounds = candidates.groupBy("digest").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    unequal = written(bounds.filter("least <> most").select("digest"), "unequal-chunks")
    if not unequal.isEmpty():  # digests that stand for different bytes: such chunks stay
        marked = joined.withColumn("key", F.monotonically_increasing_id())
        marked = written(marked, "marked-documents")
        kept = marked.select("key", F.explode("marks").alias("m")).join(unequal.withColumnRenamed("digest", "bad"), F.col("m.digest") == F.col("bad"), "left_anti").groupBy("key").agg(F.collect_list("m").alias("marks"))
        joined = marked.drop("marks").join(kept, "key", "left").drop("key")
    gone = F.coalesce(F.filter("marks", lambda m: ~m["stays"]), F.array().cast("array<struct<place:int,last:int,digest:binary,stays:boolean>>"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(_lines(body)))
    out = joined.select("row", n_lines.alias("n"), gone.alias("gone"))
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda m: F.sequence(m["place"], m["last"]))))
    out = out.select("row", "n", F.size("gone").alias("n_gone"), covered.alias("covered"))
    left = _let(_lines(body), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("covered")), lambda i: F.get(x, i)))
    text = F.when(F.col("n_gone") == 0, body).otherwise(F.array_join(left, "\n"))
    added = {"n_lines": F.col("n").cast("long"), "n_removed_lines": F.size("covered").cast("long"), "n_removed_chunks": F.col("n_gone").cast("long")}
    return out.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in own if c not in added], *[v.alias(k) for k, v in added.items()])
