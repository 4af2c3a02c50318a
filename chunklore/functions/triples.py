"""Extracted triples (subject, relation, object) as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RAW = "array<struct<extraction:struct<arg1:struct<text:string>,rel:struct<text:string>,arg2s:array<struct<text:string>>>>>"
TRIPLES = "array<struct<subject:string,relation:string,object:string>>"


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def flattened(raw_json: Column) -> Column:
    """An extractor's JSON to one triple for each second argument; those with an empty part are left out."""
    items = F.filter(F.coalesce(F.from_json(raw_json, RAW), F.array().cast(RAW)), lambda x: x.isNotNull())

    def of(item: Column) -> Column:
        e = item["extraction"]
        return F.transform(
            F.coalesce(e["arg2s"], F.array().cast("array<struct<text:string>>")),
            lambda o: F.named_struct(F.lit("subject"), _text(e["arg1"]["text"]), F.lit("relation"), _text(e["rel"]["text"]), F.lit("object"), _text(o["text"])),
        )

    return F.filter(F.flatten(F.transform(items, of)), full)


def full(t: Column) -> Column:
    return (_text(t["subject"]) != "") & (_text(t["relation"]) != "") & (_text(t["object"]) != "")


def _key(t: Column) -> Column:
    return F.concat_ws("|", *[F.lower(strip(t[p])) for p in ("subject", "relation", "object")])


def deduplicated(triples: Column) -> Column:
    """The first of those that are equal but for case and outer blanks, in order."""
    return F.transform(
        F.array(F.transform(triples, _key)),
        lambda keys: F.filter(triples, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1),
    )[0]


def in_parentheses(triples: Column) -> Column:
    """(subject; relation; object) of each, by blanks."""
    return F.array_join(F.transform(F.filter(triples, full), lambda t: F.concat(F.lit("("), _text(t["subject"]), F.lit("; "), _text(t["relation"]), F.lit("; "), _text(t["object"]), F.lit(")"))), " ")


def as_sentences(triples: Column, most: int | None = None) -> Column:
    """subject relation object. of each of the first ``most``, by blanks; null if there are none."""
    some = triples if most is None else F.slice(triples, 1, most)
    line = lambda c: _text(F.translate(c, "\t\n", "  "))
    out = F.array_join(F.transform(F.filter(some, full), lambda t: F.concat(F.concat_ws(" ", line(t["subject"]), line(t["relation"]), line(t["object"])), F.lit("."))), " ")
    return F.nullif(out, F.lit(""))


def with_triples(text: Column, triples_text: Column, stripped: bool = False) -> Column:
    """The text, a blank and the triples, or the text alone."""
    out = F.when(F.coalesce(triples_text, F.lit("")) != "", F.concat(text, F.lit(" "), triples_text)).otherwise(text)
    return strip(out) if stripped else out
