from chunklore.llm import linededup

from . import cases

BASE, MODULUS = linededup.BASE, linededup.MODULUS


def plain_chunks(text, divisor=4, most=8):
    """(first line, last line, text) of every chunk."""
    import hashlib

    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in full]
    hit = [(x + BASE * (h[k - 1] if k else 0)) % MODULUS % divisor != 0 for k, x in enumerate(h)]
    for k in range(len(full) - 1):
        end = k + 1
        while not hit[end] and end < min(k + most, len(full)) - 1:
            end += 1
        yield full[k], full[end], "\n".join(lines[full[k] : full[end] + 1])


def plain(rows):
    first, out = {}, []
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    for d, text in rows:
        for a, b, chunk in plain_chunks(text or ""):
            first.setdefault(chunk, (d, a, b))
    for d, text in rows:
        gone = set()
        for a, b, chunk in plain_chunks(text or ""):
            if first[chunk][0] != d or a > first[chunk][2]:
                gone.update(range(a, b + 1))
        lines = [] if text is None else text.split("\n")
        out.append((d, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows() if r[0] is not None]
    found = linededup.without_repeated_chunks(cases.frame(spark).filter("doc_id IS NOT NULL"))
    assert found.columns[: len(cases.frame(spark).columns)] == cases.frame(spark).columns
    got = set(cases.collected(found, "doc_id", "text", "n_lines", "n_removed_lines"))
    assert got == set(plain(rows))
    assert found.count() == len(rows)  # the repeated row too


def test_null_ids_come_last(spark):
    text = "one line here\ntwo lines here\nthree lines here\nfour lines here\n" * 3
    docs = spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in linededup.without_repeated_chunks(docs).collect()}
    assert found[None].n_removed_chunks >= found[7].n_removed_chunks


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"passage line number {i} with words" for i in range(40))
    docs = spark.createDataFrame([(1, "head\n" + passage), (2, "other\nhead\nlines\n" + passage + "\ntail")], "doc_id long, text string")
    found = {r.doc_id: r for r in linededup.without_repeated_chunks(docs).collect()}
    assert found[1].n_removed_lines == 0 and found[2].n_removed_lines >= 38


def test_short_passages_are_found(spark):
    """Passages of two to six lines in surroundings of their own: how many lose lines."""
    import random

    rng = random.Random(4)
    own = lambda: " ".join(rng.choices(cases.WORDS, k=9)) + f" {rng.random()}"
    rows, spans = [], {}
    for k in range(400):
        n = 2 + k % 5
        passage = [own() for _ in range(n)]
        for d in (2 * k, 2 * k + 1):
            rows.append((d, "\n".join([*[own() for _ in range(3)], *passage, *[own() for _ in range(3)]])))
        spans[2 * k + 1] = n
    found = {r.doc_id: r.n_removed_lines for r in linededup.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[d] for d in found if d not in spans)
    caught = {n: [found[d] > 0 for d, m in spans.items() if m == n] for n in range(2, 7)}
    print("FIG passages caught by lines", {n: (sum(x), len(x)) for n, x in caught.items()})
    assert sum(caught[2]) >= 48 and all(sum(caught[n]) >= 68 for n in (3, 4, 5, 6))
    assert all(found[d] <= n for d, n in spans.items())


def test_repeats_within_a_text(spark):
    docs = spark.createDataFrame([(1, "a line\n" * 5 + "\nx y\n\nz\n" * 3), (2, "\n\n"), (3, "z\n")], "doc_id long, text string")
    found = linededup.without_repeated_chunks(docs)
    assert set(cases.collected(found, "doc_id", "text", "n_lines", "n_removed_lines")) == set(plain([tuple(r) for r in docs.collect()]))


def test_long_text(spark):
    text = "\n".join(f"line {i % 700} of many" for i in range(60_000))
    found = linededup.without_repeated_chunks(spark.createDataFrame([(1, text), (2, "same\n" * 60_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.text) < 20_000 for r in found} == {1: True, 2: True}


def test_no_rows(spark):
    assert linededup.without_repeated_chunks(cases.empty(spark)).count() == 0


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5)], "doc_id long, text string, `a.b` int")
    assert linededup.without_repeated_chunks(docs).collect()[0]["a.b"] == 5


def test_extra_column_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, "m", "k")], "doc_id long, text string, n_lines int, marks string, digest string")
    row = linededup.without_repeated_chunks(docs).collect()[0]
    assert row.n_lines == 2 and row.marks == "m" and row.digest == "k"
