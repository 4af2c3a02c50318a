"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, odd characters, clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, place int, benchmark_hits string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int = 80) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def rows():
    a, b = prose(1), prose(2, 200)
    long_text = " ".join(prose(i, 100) for i in range(10, 40))
    texts = [a, a, b, b.replace("alpha", "alpho", 1), None, "", "   ", "x", "é ñ ß — 日本語 テスト", "a\tb\x0bc\x0cd\re", long_text, "ab" * 3000, "line one here\nline two here\nline three here\n" * 4, "line one here\nline two here\nline three here\n" * 4 + "tail", "<|endoftext|> and <|startoftext|>", "!!! ### $$$"]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", 0, 1.0, 1, "x") for i, t in enumerate(texts)]
    return [*out, out[0], (None, a, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *cols):
    return [tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect()]
