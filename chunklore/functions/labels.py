"""Relevance labels from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Words for labels (fixed values).
POSITIVE = ["1", "+1", "true", "yes", "y", "relevant", "rel", "pos", "+", "positive"]
NEGATIVE = ["0", "-1", "false", "no", "n", "irrelevant", "nonrelevant", "neg", "-", "negative"]


def numeric_label(text: Column) -> Column:
    """The number, truncated to an int; null for anything else, infinities and NaN too."""
    number = strip(text.cast("string")).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(2147483648.0))
    return F.when(finite, number).cast("int")


def mapped_label(text: Column) -> Column:
    """1 or 0 for the words above, else the number."""
    word = F.lower(strip(text.cast("string")))
    return F.when(word.isin(POSITIVE), 1).when(word.isin(NEGATIVE), 0).otherwise(numeric_label(text))
