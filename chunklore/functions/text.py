"""Text functions, Column in and Column out.

White space and word characters are Unicode's throughout, as in Python's ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Text that a collection uses for an empty document (fixed value).
NO_INFORMATION = "This document has no information."


def collapse(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, SPACE, " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """One line, single blanks, no blank at either end; null becomes empty."""
    return strip(collapse(F.coalesce(text, F.lit(""))))


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_profile(text: Column) -> Column:
    """Splitter A: collapsed, cut at blanks after . ! ?"""
    return _full(F.split(collapse(text), r"(?<=[.!?])\s+"))


def sentences_chunk_profile(text: Column) -> Column:
    """Splitter B: as A, not collapsed, full-width marks too."""
    return _full(F.split(text, r"(?U)(?<=[.!?！？。])\s+"))


def _ended(sentence: Column) -> Column:
    return F.when(sentence.rlike(r"[.!?]$"), sentence).otherwise(F.concat(sentence, F.lit(".")))


def sentences_strict(text: Column, min_length: int = 10) -> Column:
    """Splitter C: cut only before A-Z, sentences under ``min_length`` dropped, a missing end mark added."""
    parts = _full(F.split(normalize(text), r"(?<=[.!?])\s+(?=[A-Z])"))
    return F.transform(F.filter(parts, lambda s: F.length(s) >= min_length), _ended)


def sentences_bounded(text: Column, max_length: int = 1000, min_length: int = 10) -> Column:
    """Splitter D: C's sentences; those over ``max_length`` are cut at blanks after . ! ? ; as well."""
    parts = _full(F.split(normalize(text), r"(?<=[.!?])\s+(?=[A-Z])"))
    long_ones = F.transform(parts, lambda s: F.when(F.length(s) > max_length, _full(F.split(s, r"(?<=[.!?;])\s+"))).otherwise(F.array(s)))
    return F.transform(F.filter(F.flatten(long_ones), lambda s: F.length(s) >= min_length), _ended)


def sentences_plain(text: Column) -> Column:
    """Splitter E: as C's cut alone."""
    return _full(F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])"))


def simplified(sentences: Column) -> Column:
    """Cut at semicolons, then at the first ``, and/but/or`` with four words or more on both sides; what follows a second one is lost."""
    parts = _full(F.flatten(F.transform(sentences, lambda s: F.split(s, ";"))))

    def halves(part: Column) -> Column:
        cut = F.split(part, r"(?U),\s+(?:and|but|or)\s+")
        first, second = strip(cut[0]), strip(F.get(cut, F.lit(1)))
        dot = lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))
        both = (F.size(cut) >= 2) & (F.size(words(first)) >= 4) & (F.size(words(second)) >= 4)
        return F.when(both, F.array(dot(first), dot(second))).otherwise(F.array(part))

    return F.flatten(F.transform(parts, halves))


def integrate_query_clean(text: Column) -> Column:
    """Tabs and runs of blanks to one blank; doubled quotes to one, quotes to apostrophes."""
    out = strip(collapse(text))
    return F.replace(F.replace(out, F.lit('""'), F.lit('"')), F.lit('"'), F.lit("'"))


def integrate_document_clean(text: Column) -> Column:
    """As for queries; carriage returns vanish first."""
    return integrate_query_clean(F.replace(text, F.lit("\r"), F.lit("")))


def truncated(text: Column, most: int = 50_000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def chunk_clean(text: Column, most: int = 50_000) -> Column:
    """What a chunk's text is when written: one line, no blanks at the ends, not over ``most`` characters."""
    return truncated(strip(F.translate(text, "\t\n\r", "   ")), most)
