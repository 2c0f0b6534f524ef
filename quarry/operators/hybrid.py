"""Hybrid search: reciprocal-rank fusion of keyword and dense lists, optional reranking, one hit an item."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexical, vector
from .items import SearchFilters

RRF_K = 60
OVERFETCH = 5


def ranks(hits: DataFrame, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """hits with rank from 0; hits is a short list (a few times a limit), so one task may order it."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)) - 1)


def fuse(*lists: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, score): the sum of 1 / (60 + place) over the lists."""
    parts = [ranks(x, key).select(key, (1.0 / (RRF_K + F.col("rank") + 1)).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def best_per_item(hits: DataFrame, item: str = "item_key", key: str = "chunk_id", score: str = "score") -> DataFrame:
    w = Window.partitionBy(item).orderBy(F.col(score).desc(), key)
    return hits.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


Reranker = Callable[[str], Callable[[Column], Column]]


def overlap_reranker(query: str) -> Callable[[Column], Column]:
    """The share of the query's distinct words that a text has: the built-in reranker."""
    words = sorted(set(lexical.terms_of(query)))
    wanted = F.array(*[F.lit(w) for w in words])

    def score(text: Column) -> Column:
        from ..functions.text import tokens

        return F.size(F.array_intersect(F.array_distinct(tokens(text)), wanted)) / F.lit(float(max(1, len(words))))

    return score


def batch_reranker(factory, batch: int = 32) -> Reranker:
    """A cross-encoder behind a factory: factory() gives a function from (query, texts) to scores; loaded once a task."""

    def of(query: str) -> Callable[[Column], Column]:
        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for texts in batches:
                values = texts.fillna("").tolist()
                yield pd.Series([float(s) for i in range(0, len(values), batch) for s in model(query, values[i : i + batch])], index=texts.index)

        return score

    return of


def search(
    chunks: DataFrame,
    query: str,
    query_vector: list[float],
    limit: int,
    filters: SearchFilters | None = None,
    reranker: Reranker | None = None,
    found: DataFrame | None = None,
    stats: DataFrame | None = None,
    stemming: bool = True,
    compat_threshold: bool = False,
    terms: DataFrame | None = None,
    tops: DataFrame | None = None,
    cells: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The best chunk of each of at most `limit` items, with all its columns and score.

    Both lists hold 5 * limit chunks that pass the filters. A reranker scores the fused chunks and keeps `limit` of them
    before items are made distinct, so that fewer items may come out. compat_threshold drops reranked scores of -1 or
    less; where that leaves nothing, the fused hits come out as they would without a reranker.
    """
    k = OVERFETCH * limit
    words = lexical.search(chunks, query, k, filters, found, stats, stemming, terms, tops)
    if cells is None:
        dense = vector.search(chunks, query_vector, k, filters)
    else:  # an index's vectors, and the cells that they are kept in
        allowed = filters.apply(chunks).select("chunk_id") if filters is not None and filters.any() else None
        dense = vector.near(*cells, query_vector, k, allowed)
    fused = lexical.top(fuse(words, dense), k)
    # At most 5 * limit rows: their ids go to the scan as literals, which skip what an index sorted by chunk_id keeps apart.
    found_ids = [(r.chunk_id, r.score) for r in fused.collect()]
    scores = chunks.sparkSession.createDataFrame(found_ids, "chunk_id string, score double")
    hits = chunks.where(F.col("chunk_id").isin(*[i for i, _ in found_ids])).join(F.broadcast(scores), "chunk_id")
    if reranker is not None:
        rescored = lexical.top(hits.withColumn("score", reranker(query)(F.col("text")).cast("double")), limit)
        kept = rescored.where(F.col("score") > -1) if compat_threshold else rescored
        if not compat_threshold or not kept.isEmpty():
            return lexical.top(best_per_item(kept), limit)
    return lexical.top(best_per_item(hits), limit)


def search_output(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("item_key").alias("key"), "title", "creators", "date", "item_type", F.col("text").alias("snippet"), "score", "char_start", "char_end", "chunk_type",
    ).orderBy(F.col("score").desc(), "key")
