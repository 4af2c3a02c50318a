"""Named run configurations: what a run is called, which chunker it takes, and with which parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions.text import NO_INFORMATION, sentences_bounded
from ..operators import chunking, contiguous, grouping
from ..operators.contiguous import Splitter
from ..operators.grouping import Grouper


@dataclass(frozen=True)
class Fixed:
    size: int = 600
    overlap: int = 0


@dataclass(frozen=True)
class Config:
    name: str
    how: Splitter | Grouper | Fixed


#: By name, in the order in which numbers choose them. Parameters that a configuration gives take effect; where ``auto`` is on the document decides the rest.
CONFIGS = {
    c.name: c
    for c in (
        Config("semantic_splitter_auto", Splitter(local_rank=True)),
        Config("semantic_grouping_auto", Grouper()),
        Config("semantic_splitter_global", Splitter(auto=False, min_spacing=12, min_first=8, hybrid="intersection", valley_tau=0.1, sim_tau=0.45, vote=0.9, knee=1.3, knee_window=5, smooth_window=5, soft_cap=24)),
        Config("semantic_grouping_cluster", Grouper(auto=False, engine="spectral", sigmoid_tau=0.12, knn=6, edge_floor=0.5, spectral_kmax=12, cap=24, small=6, tau_merge=0.22, keep_eigenvalues=2, gamma_start=0.5, gamma_end=1.2)),
        Config("semantic_splitter_ce_dp", Splitter(dp_penalty=0.05)),
        Config("semantic_grouping_consensus", Grouper(gamma_start=0.4, gamma_end=1.8, gamma_step=0.12)),
        Config("text_splitter_char_naive", Fixed(600, 0)),
    )
}


def chosen(*names: str) -> list[Config]:
    """Configurations by name or by number from 1; all without any."""
    every = list(CONFIGS.values())
    return [every[int(n) - 1] if n.isdigit() else CONFIGS[n] for n in names] or every


def run(docs: DataFrame, configs: list[Config], id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """config, doc_id, chunk_index, chunk_id, chunk_text of every configuration, as it is written. With clean, wire texts are cleaned first where that changes no more than the guard lets
    pass; texts that say there is no information give nothing. Every document is cleaned and cut into sentences once, then dealt evenly, as the chunkers cost far more than
    its way there, and goes through all configurations in one pass."""
    if not configs:
        raise ValueError("no configuration")
    text, body = F.col(text_col), F.col("text")
    cleaned = cleaning.guarded(text, cleaning.corpus_clean(cleaning.interview_format(text))) if clean else text
    # a filter on the text would be pushed below and clean every text once more; on what an outer explode gives it can't be
    informing = F.filter(F.array(cleaned), lambda t: F.trim(t) != NO_INFORMATION)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(informing).alias("text")).filter(F.col("text").isNotNull())
    kinds = {type(c.how) for c in configs}
    sentences = {Splitter: sentences_bounded(cleaning.splitter_preclean(body)).alias("split_sentences"), Grouper: sentences_bounded(cleaning.grouping_preclean(body)).alias("group_sentences")}
    rows = rows.select("doc_id", "text", *[s for kind, s in sentences.items() if kind in kinds])
    if kinds != {Fixed}:
        rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "doc_id")
    # chunkers of a kind share what they make of a text
    finders = {Splitter: (contiguous.finder, "split_sentences"), Grouper: (grouping.finder, "group_sentences")}
    alike = {kind: [i for i, c in enumerate(configs) if type(c.how) is kind] for kind in finders if kind in kinds}
    rows = rows.select("*", *[find([configs[i].how for i in alike[kind]])(of).alias(f"{of}_found") for kind, (find, of) in finders.items() if kind in kinds])
    doc_id = F.col("doc_id")

    def chunks(i: int, c: Config) -> Column:
        if isinstance(c.how, Splitter):
            made = contiguous.texts(doc_id, body, F.col("split_sentences"), F.col("split_sentences_found")[alike[Splitter].index(i)])
        elif isinstance(c.how, Grouper):
            made = grouping.texts(doc_id, F.col("group_sentences"), F.col("group_sentences_found")[alike[Grouper].index(i)])
        else:
            made = chunking.fixed_width(body, doc_id, c.how.size, c.how.overlap)
        return F.transform(made, lambda x: F.struct(F.lit(c.name).alias("config"), x["chunk_index"].alias("chunk_index"), x["chunk_id"].alias("chunk_id"), x["chunk_text"].alias("chunk_text")))

    out = rows.select("doc_id", F.explode(F.concat(*[chunks(i, c) for i, c in enumerate(configs)])).alias("c"))
    return chunking.written_form(out.select("c.config", "doc_id", "c.chunk_index", "c.chunk_id", "c.chunk_text"))
