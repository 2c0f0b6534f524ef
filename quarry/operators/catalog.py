"""Catalogue queries: find, get, fulltext, pdf, tags, authors, status, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, creators_string, display_name, fulltext_slice
from ..model import ISSUE_ORDER, STATUSES
from ..session import stored
from .extract import first_pdf
from .items import contains_ignoring_case, find_output, is_regular, item_output

SORTS = {"title": "title", "date": "date", "dateAdded": "date_added", "dateModified": "date_modified", "creator": "creators", "itemType": "item_type"}


def find(
    items: DataFrame,
    query: str = "",
    everything: bool = False,
    tag: str | None = None,
    item_type: str | None = None,
    collection: str | None = None,
    creator: str | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int = 25,
) -> DataFrame:
    """Regular items in which every word of query (and of creator) occurs, ignoring case.

    Words are looked for in title, creators and date, or with `everything` in all text fields. item_type takes the place
    of the rule that leaves out attachments, notes and annotations. The direction only counts with a sort; ties and unsorted results go by key.
    """
    names = F.array_join(F.transform("creators", display_name), " ")
    fields = [F.col("title"), names, F.col("date")]
    if everything:
        fields += [F.col("abstract_note"), F.col("publication_title"), F.col("doi"), F.col("url"), F.array_join("tags", " "), F.col("extra")]
    found = items.where(F.col("item_type") == item_type) if item_type is not None else items.where(is_regular())
    if tag is not None:
        found = found.where(F.array_contains("tags", tag))
    if collection is not None:
        found = found.where(F.array_contains("collections", collection))
    for word in f"{query} {creator or ''}".split():
        found = found.where(contains_ignoring_case(F.concat_ws("\n", *fields), word))
    order = [F.col("item_key")]
    if sort:
        key = creators_string("creators") if sort == "creator" else F.col(SORTS[sort])
        order.insert(0, key.desc() if descending else key.asc())
    return find_output(found.orderBy(*order).limit(limit)) if limit is not None else find_output(found.orderBy(*order))


def get(items: DataFrame, key: str) -> DataFrame:
    return item_output(items.where(F.col("item_key") == key).limit(1))


def fulltext(chunks: DataFrame, key: str, start: int | None = None, end: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(key, title, total_chars, start, end, text): no row without full text; text is null where start is beyond it."""
    row = chunks.where((F.col("item_key") == key) & (F.col("chunk_type") == "metadata") & (F.coalesce("fulltext", F.lit("")) != "")).limit(1)
    return row.select(F.col("item_key").alias("key"), "title", fulltext_slice("fulltext", start, end, max_chars).alias("s"), F.length("fulltext").alias("total_chars")).select(
        "key", "title", "total_chars", "s.start", "s.end", "s.text"
    )


def pdf(kids: DataFrame, key: str) -> DataFrame:
    """(key, path): the location of the item's first document child, or null."""
    one = kids.sparkSession.range(1).select(F.lit(key).alias("key"))
    found = first_pdf(kids.where(F.col("item_key") == key)).select(F.col("item_key").alias("key"), F.col("location").alias("path"))
    return one.join(found, "key", "left")


def tags(items: DataFrame, contains: str | None = None, key="item_key", column="tags") -> DataFrame:
    """(tag, num_items), by tag without regard to case."""
    each = items.select(col(key).alias("k"), F.explode(col(column)).alias("tag"))
    if contains is not None:
        each = each.where(contains_ignoring_case("tag", contains))
    return each.groupBy("tag").agg(F.countDistinct("k").alias("num_items")).orderBy(F.lower("tag"), "tag")


def authors(items: DataFrame, contains: str | None = None) -> DataFrame:
    """(author): distinct names of creators of any role, in code-point order."""
    names = items.select(F.explode(F.transform("creators", display_name)).alias("author")).where("author <> ''")
    if contains is not None:
        names = names.where(contains_ignoring_case("author", contains))
    return names.distinct().orderBy("author")


def status_breakdown(status: DataFrame, item_count) -> DataFrame:
    """(status, count) in display order, with 'unknown' for items that have no status. item_count: a number or a one-row table."""
    counted = status.groupBy("status").agg(F.count("*").alias("count"))
    order = F.create_map(*[x for i, s in enumerate([*STATUSES, "unknown"]) for x in (F.lit(s), F.lit(i))])
    if isinstance(item_count, DataFrame):
        items = item_count.toDF("items")
        unknown = status.agg(F.count("*").alias("tracked")).crossJoin(items).select(F.lit("unknown").alias("status"), F.greatest(F.col("items") - F.col("tracked"), F.lit(0)).cast("long").alias("count"))
    else:
        unknown = status.agg(F.greatest(F.lit(item_count) - F.count("*"), F.lit(0)).cast("long").alias("count")).select(F.lit("unknown").alias("status"), "count")
    every = counted.unionByName(unknown.where(F.col("count") > 0))
    return every.withColumn("place", F.coalesce(order[F.col("status")], F.lit(len(STATUSES) + 1))).orderBy("place", "status").select("status", "count")


def issue_rank(status="status") -> Column:
    out = None
    for name, rank in ISSUE_ORDER.items():
        out = F.when(col(status) == name, rank) if out is None else out.when(col(status) == name, rank)
    return out.otherwise(len(ISSUE_ORDER))


def issues(status: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, title, status, detail) of everything that isn't ok, worst first. titles: (item_key, title)."""
    bad = status.where(F.col("status") != "ok")
    return (
        bad.join(titles.select("item_key", "title"), "item_key", "left")
        .orderBy(issue_rank(), "item_key")
        .select(F.col("item_key").alias("key"), F.coalesce("title", F.lit("")).alias("title"), "status", "detail")
    )


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank, from 1, in this order: ranges are sorted apart, and a range's first rank is the sum of the counts before it."""
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at_", 33)  # of the id: the partition, and below it the row's place there
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    firsts = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    placed = rows.withColumn("part_", part).join(F.broadcast(firsts), "part_")
    return placed.withColumn("rank", F.col("first_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).drop("part_", "at_", "first_")


def without_fulltext(chunks: DataFrame) -> DataFrame:
    """Metadata chunks whose item has no full text."""
    return chunks.where((F.col("chunk_type") == "metadata") & (F.coalesce("fulltext", F.lit("")) == ""))
