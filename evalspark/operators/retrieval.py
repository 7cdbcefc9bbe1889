"""Exemplar retrieval: exact top-k by cosine similarity (T8, pivot cells) and TF-IDF (T9, inverted index)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators.cosine_index import CosineIndex, l2_normalize, topk_cosine
from evalspark.operators.term_index import tfidf_fit, tfidf_topk

__all__ = ["CosineIndex", "l2_normalize", "semantic_picks", "tfidf_fit", "tfidf_topk", "topk_cosine"]


def semantic_picks(query_text: str = "ctx", pool_text: str = "ctx"):
    """T10 hook: few-shot picks ``(ind, j, pool_id)`` by TF-IDF similarity of contexts."""
    def picks(items, pool, k: int):
        q = items.select(F.col("ind"), F.col(query_text).alias("_qt"))
        top = tfidf_topk(q, pool, k, "ind", "_qt", "pool_id", pool_text)
        return top.select("ind", (F.col("rank") - 1).cast("int").alias("j"), "pool_id")
    return picks
