"""Chunking: a metadata chunk for each item, and overlapping windows over its full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, metadata_text

SIZE = 1500
OVERLAP = 200
SLAB = 16


def windows(c, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<i, start, end, text>>: windows of size characters, each overlap characters into the one before."""
    text = col(c)
    step = size - overlap if size > overlap else 1
    length = F.length(text)
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / step)).cast("int")
    numbers = F.when(length > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # A character is found by counting from a text's begin: a long one is cut to slabs of some windows first, and windows from their slab.
    slabs = F.transform(
        F.filter(numbers, lambda i: i % SLAB == 0),
        lambda i: F.struct(i.alias("first"), F.least(i + (SLAB - 1), last).alias("last"), length.alias("length"), F.substring(text, i * step + 1, F.lit(SLAB * step + size)).alias("part")),
    )
    each = lambda s: F.transform(
        F.sequence(s["first"], s["last"]),
        lambda i: F.struct(
            i.alias("i"),
            (i * step).cast("long").alias("start"),
            F.least(i * step + size, s["length"]).cast("long").alias("end"),
            F.substring(s["part"], (i - s["first"]) * step + 1, F.lit(size)).alias("text"),
        ),
    )
    return F.flatten(F.transform(slabs, each))


def fulltext_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, carry: list[str] | None = None) -> DataFrame:
    """(chunk_id, item_key, chunk_type, i, char_start, char_end, text) and the columns to carry, which come along without a join."""
    carried = [F.col(c) for c in carry or []]
    exploded = df.select(F.col(key).cast("string").alias("item_key"), *carried, F.explode(windows(text, size, overlap)).alias("w"))
    return exploded.select(
        F.concat_ws("_", "item_key", F.col("w.i").cast("string")).alias("chunk_id"),
        "item_key",
        F.lit("fulltext").alias("chunk_type"),
        F.col("w.i").alias("i"),
        F.col("w.start").alias("char_start"),
        F.col("w.end").alias("char_end"),
        F.col("w.text").alias("text"),
        *carried,
    )


def metadata_chunks(items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One chunk for each item, of title, authors, abstract and tags; also for items without any of them."""
    return items.select(
        F.concat("item_key", F.lit("_meta")).alias("chunk_id"),
        "item_key",
        F.lit("metadata").alias("chunk_type"),
        F.lit(-1).alias("i"),
        F.lit(0).cast("long").alias("char_start"),
        F.lit(0).cast("long").alias("char_end"),
        metadata_text("title", "creators", "abstract_note", F.array_join("tags", ", ")).alias("text"),
        *[F.col(c) for c in carry or []],
    )


def chunk_items(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP, carry: list[str] | None = None) -> DataFrame:
    """All chunks of items (item_key, title, creators, abstract_note, tags, fulltext), with the columns to carry."""
    return metadata_chunks(items, carry).unionByName(fulltext_chunks(items, "item_key", "fulltext", size, overlap, carry))


def owns(chunk_id, item_key) -> Column:
    """Whether a chunk id belongs to an item: its key, or its key and '_' and more."""
    c, k = col(chunk_id), col(item_key)
    return (c == k) | c.startswith(F.concat(k, F.lit("_")))
