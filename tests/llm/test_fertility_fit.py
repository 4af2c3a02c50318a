"""Bands fitted to the corpus: noise among prose goes, prose stays."""

import random

from chunklore.llm import fertility
from chunklore.llm.queries import op7_tokenizer_fertility


def test_noise_goes_and_prose_stays(spark, sf):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(100)) for _ in range(3)]
    noise += [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(100)) for _ in range(3)]
    noise += [" ".join("".join(rng.choice("#*$%&|<>!?") for _ in range(5)) for _ in range(60))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    prose = [r.text for r in docs.collect()]
    marked = [" ".join(w + rng.choice(["&&&", "###", "$$$", "***"]) for w in prose[k].split()[:300]) for k in range(3)]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise + marked)], "doc_id long, text string")
    found = {r.doc_id: r for r in fertility.fertility_rules(docs.unionByName(more)).collect()}
    assert not any(found[-1 - i].kept for i in range(len(noise + marked)))
    good = [r for r in found.values() if r.doc_id >= 0 and not r.base_failed and r.n_symbols == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_query_rejects_labelled_symbol_noise(spark):
    d = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = [r for r in op7_tokenizer_fertility(spark, d).collect() if not r.base_failed]
    marked = [r.kept for r in found if r.n_symbols > 0.25 * r.word_chars]
    clean = [r.kept for r in found if quality.get(r.doc_id) == 1]
    assert len(marked) > 10 and not any(marked) and sum(clean) >= 0.97 * len(clean)
    print("FIG passed base", len(found), "rejected", sum(not r.kept for r in found), "label 0:", sum(quality.get(r.doc_id) == 0 and not r.kept for r in found), "of", sum(quality.get(r.doc_id) == 0 for r in found), "label 1:", len(clean) - sum(clean), "of", len(clean), "over 0.25 symbols", len(marked))
