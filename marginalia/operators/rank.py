"""Relevance score, the two result orders, pages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BM25 parameters.
K1 = 1.2
B = 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    """One word's part of a document's score in one field."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl)
    return weight * (K1 + 1) * tf / (tf + norm)


def page_of(ordered: DataFrame, page: int, size: int) -> DataFrame:
    """The 1-based page of an ordered result; limit and offset fuse into one top-k."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return ordered.offset((page - 1) * size).limit(size)


def best_first(scored: DataFrame, page: int, size: int) -> DataFrame:
    """Highest score first, earlier documents first on ties."""
    return page_of(scored.orderBy(F.desc("score"), "doc_id"), page, size)


def newest_first(posts: DataFrame, page: int, size: int) -> DataFrame:
    """Newest first, earlier documents first on ties."""
    return page_of(posts.orderBy(F.desc("date"), "doc_id"), page, size)
