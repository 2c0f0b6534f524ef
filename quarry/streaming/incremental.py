"""Incremental indexing of a growing folder of item records, as a stream of micro-batches.

The index's store is the only state, and a batch is one commit: beside chunks and statuses it holds the latest record of each item
and attachment that the stream has seen. A batch holds records written since the last one: new or changed ones,
and deletions (records with a key and "deleted": true). It looks again at every work whose own record came, and at every work one of
whose attachments came, changed, moved or went, in whichever batch that work came itself. An attachment
without its work waits in the store. A batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.index import Reports, build_index
from ..plans.store import SnapshotStore
from ..session import stored
from ..sources.library import Files, parse_deletions, parse_items


def latest(items: DataFrame) -> DataFrame:
    """The newest record of each key in a batch; a deletion counts as later than a record of its version."""
    w = Window.partitionBy("item_key").orderBy(F.col("version").desc(), *[F.col(c).desc() for c in ("gone_",) if c in items.columns])
    return items.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def index_batch(store: SnapshotStore, embedder, batch: DataFrame, files: Files | DataFrame | None = None, reports: Reports | None = None, deletions: DataFrame | None = None):
    """One micro-batch of items, and of keys that are gone; items that neither names count as still there."""
    known, names = store.table("items"), batch.columns
    if deletions is None:
        deletions = batch.select("item_key", "version").limit(0)
    both = batch.withColumn("gone_", F.lit(False)).unionByName(deletions.withColumn("gone_", F.lit(True)), allowMissingColumns=True)
    newest = stored(latest(both), "batch")
    new, keys = newest.where("not gone_").select(*names), newest.select("item_key")
    before = known.join(keys, "item_key", "left_semi")
    # Works with an attachment that came, changed, moved or went.
    parents = new.select("parent_item").unionByName(before.select("parent_item")).where("parent_item <> ''").select(F.col("parent_item").alias("item_key")).distinct()
    works = stored(new.where("parent_item = ''").select("item_key").union(parents).distinct(), "works")
    rest = known.join(keys, "item_key", "left_anti")
    own = rest.join(works, "item_key", "left_semi")
    kids = rest.join(works.select(F.col("item_key").alias("parent_item")), "parent_item", "left_semi").select(*names)
    others = store.table("versions").join(works.union(keys), "item_key", "left_anti").select("item_key", "version", F.lit("").alias("parent_item"))
    items = new.unionByName(own.select(*names)).unionByName(kids).dropDuplicates(["item_key"])
    items = stored(items.unionByName(others, allowMissingColumns=True), "items")
    return build_index(store, items, embedder, files, reports, requeue=parents, also={"items": (keys, new)})


def index_stream(spark: SparkSession, path: str, store: SnapshotStore, embedder, checkpoint: str, files: Files | DataFrame | None = None, reports: Reports | None = None):
    """Index the JSON lines that have arrived below path since the last call, then stop; returns the query."""

    def each(batch: DataFrame, _: int) -> None:
        store.refresh()
        index_batch(store, embedder, parse_items(batch.where(~_says_deleted())), files, reports, parse_deletions(batch))

    lines = spark.readStream.schema("value string").text(path)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _says_deleted():
    return F.coalesce(F.get_json_object("value", "$.deleted") == "true", F.lit(False))
