"""Column names: what inputs may call them, and how they are found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Synonyms by role, in priority order.
RANKING = {"query_text": ["query_text", "query", "question"], "chunk_text": ["chunk_text", "passage", "text"], "label": ["label", "score", "target"], "query_id": ["query_id", "qid"], "chunk_id": ["chunk_id", "cid", "pid"]}
PAIRS = {"query_text": ["query_text", "query", "q", "question", "text_left"], "chunk_text": ["chunk_text", "passage", "document", "doc", "text", "answer", "text_right"], "label": ["label", "relevance", "rel", "y"]}
FOLDS = {"text_left": ["query_text", "query", "q", "question"], "text_right": ["chunk_text", "passage", "document", "doc", "text", "answer"], "label": ["label", "relevance", "rel", "y"]}


@dataclass(frozen=True)
class Resolution:
    """mode ``file``: the first of the input's columns that is a synonym; ``priority``: the first synonym that the input has. With fallback, the first columns by place if
    any role is missing."""

    synonyms: dict[str, list[str]]
    mode: str = "file"
    fallback: bool = False

    def find(self, columns: list[str]) -> dict[str, str]:
        lower = {c.strip().lower(): c for c in reversed(columns)}
        found: dict[str, str] = {}
        for role, names in self.synonyms.items():
            order = [c.strip().lower() for c in columns] if self.mode == "file" else names
            hit = next((c for c in order if c in names and c in lower), None)
            if hit:
                found[role] = lower[hit]
        if self.fallback and len(found) < len(self.synonyms):
            if len(columns) < len(self.synonyms):
                raise ValueError(f"{len(self.synonyms)} columns are needed, there are {len(columns)}")
            return dict(zip(self.synonyms, columns, strict=False))
        return found


def standardized(df: DataFrame, how: Resolution) -> DataFrame:
    """Synonyms renamed to their roles; other columns as they are."""
    found = how.find(df.columns)
    return df.withColumnsRenamed({old: role for role, old in found.items() if old != role and role not in df.columns})


def resolved(df: DataFrame, how: Resolution) -> DataFrame:
    """Just the roles."""
    found = how.find(df.columns)
    if missing := set(how.synonyms) - set(found):
        raise ValueError(f"no column for {sorted(missing)} among {df.columns}")
    return df.select(*[df[old].alias(role) for role, old in found.items()])
