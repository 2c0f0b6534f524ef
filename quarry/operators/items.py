"""Item predicates, filters and projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, creators_string, display_name
from ..model import NOT_REGULAR, RETRIED, STATUS_VERSION


def is_regular(item_type="item_type") -> Column:
    return ~F.coalesce(col(item_type), F.lit("")).isin(*NOT_REGULAR)


def is_standalone_attachment(item_type="item_type", parent="parent_item") -> Column:
    return (col(item_type) == "attachment") & (col(parent) == "")


def is_standalone_pdf(item_type="item_type", parent="parent_item", content_type="content_type") -> Column:
    return is_standalone_attachment(item_type, parent) & (col(content_type) == "application/pdf")


def is_standalone_html(item_type="item_type", parent="parent_item", content_type="content_type") -> Column:
    return is_standalone_attachment(item_type, parent) & (col(content_type) == "text/html")


def is_standalone_note(item_type="item_type", parent="parent_item") -> Column:
    return (col(item_type) == "note") & (col(parent) == "")


def is_indexable(item_type="item_type", parent="parent_item") -> Column:
    return is_regular(item_type) | is_standalone_attachment(item_type, parent) | is_standalone_note(item_type, parent)


def needs_retry(status="status") -> Column:
    return col(status).isin(*RETRIED)


def is_stale_no_attachment(status="status", status_version="status_version") -> Column:
    return (col(status) == "no-attachment") & (col(status_version) < STATUS_VERSION)


def contains_ignoring_case(c, part: str) -> Column:
    return F.contains(F.lower(col(c)), F.lower(F.lit(part)))


@dataclass(frozen=True)
class SearchFilters:
    """Exact filters of a search; creator is a part of the creators' names, ignoring case."""

    tag: str | None = None
    creator: str | None = None
    item_type: str | None = None
    collection: str | None = None

    def any(self) -> bool:
        return any(x is not None for x in (self.tag, self.creator, self.item_type, self.collection))

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that pass all filters; equality on item_type reaches the scan."""
        if self.item_type is not None:
            df = df.where(F.col("item_type") == self.item_type)
        if self.tag is not None:
            df = df.where(F.array_contains("tags", self.tag))
        if self.collection is not None:
            df = df.where(F.array_contains("collections", self.collection))
        if self.creator is not None:
            df = df.where(contains_ignoring_case("creators", self.creator))
        return df


def versions(items: DataFrame) -> DataFrame:
    """(item_key, version) of top-level items."""
    return items.where(F.col("parent_item") == "").select("item_key", "version")


def by_keys(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items with these keys, one row a key."""
    return items.join(keys.select("item_key").distinct(), "item_key", "left_semi").dropDuplicates(["item_key"])


def to_indexable(items: DataFrame) -> DataFrame:
    """The fields of an item that its chunks carry."""
    return items.select(
        "item_key", "title", creators_string("creators").alias("creators"), "abstract_note", "tags", "item_type", "collections", "date", "doi", "publication_title",
    )


def find_output(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_key").alias("key"), "title", "item_type", creators_string("creators").alias("creators"), "date", "tags", "doi")


def item_output(items: DataFrame) -> DataFrame:
    people = F.transform("creators", lambda c: F.struct(display_name(c).alias("name"), F.coalesce(c["creatorType"], F.lit("")).alias("role")))
    return items.select(
        F.col("item_key").alias("key"), "title", "item_type", people.alias("creators"), "date", "abstract_note", "tags", "doi", "url", "publication_title",
        "volume", "pages", "collections", "date_added", "date_modified", "citation_key",
    )


