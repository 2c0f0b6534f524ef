"""The engine's queries over a store and a library, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, hybrid, sync, vector
from ..operators.items import SearchFilters, versions
from .store import SnapshotStore


class EmptyIndex(RuntimeError):
    """There is nothing to search yet."""


class Engine:
    def __init__(self, store: SnapshotStore, embedder, items: DataFrame | None = None) -> None:
        self.store, self.embedder, self.items = store, embedder, items

    def search(self, query: str, limit: int = 10, filters: SearchFilters | None = None, reranker=None) -> DataFrame:
        chunks = self.store.table("chunks")
        if chunks.isEmpty():
            raise EmptyIndex("the index is empty; run build_index first")
        found, stats, terms, tops, vectors, cells = (self.store.table(t) for t in ("postings", "stats", "terms", "peaks", "vectors", "cells"))
        vectors = vector.check_dimension(vectors, self.embedder.dim)
        hits = hybrid.search(chunks, query, self.embedder.one(query), limit, filters, reranker, found, stats, self.store.stemming, terms=terms, tops=tops, cells=(vectors, cells))
        return hybrid.search_output(hits)

    def sync_note(self) -> str | None:
        """What the index lacks, or None if it is up to date; never an error."""
        try:
            if self.items is None:
                raise LookupError
            counts = {r.action: r.n for r in sync.diff(versions(self.items), self.store.table("versions")).groupBy("action").agg(F.count("*").alias("n")).collect()}
        except Exception:  # noqa: BLE001  a search must go on whatever the library does
            return "Note: the library can't be read, so what the index lacks is unknown."
        if not counts:
            return None
        return f"Note: the index is behind the library: {counts.get('add', 0)} items to add or renew, {counts.get('delete', 0)} to remove. build_index brings it up to date."

    def find(self, query: str = "", **options) -> DataFrame:
        return catalog.find(self.items, query, **options)

    def get(self, key: str) -> DataFrame:
        return catalog.get(self.items, key)

    def tags(self, contains: str | None = None) -> DataFrame:
        return catalog.tags(self.items, contains)

    def authors(self, contains: str | None = None) -> DataFrame:
        return catalog.authors(self.items, contains)

    def fulltext(self, key: str, **part) -> DataFrame:
        return catalog.fulltext(self.store.table("chunks"), key, **part)

    def status(self) -> dict:
        chunks, meta = self.store.table("chunks"), self.store.table("meta").first()
        counts = chunks.agg(
            F.countDistinct("item_key").alias("items"), F.count("*").alias("chunks"), F.count("embedding").alias("vectors"),
            F.sum(((F.col("chunk_type") == "metadata") & (F.coalesce("fulltext", F.lit("")) == "")).cast("long")).alias("bare"),
        ).first()
        breakdown = [(r.status, r["count"]) for r in catalog.status_breakdown(self.store.table("status"), counts["items"]).collect()]
        return {
            "item_count": counts["items"], "chunk_count": counts.chunks, "vector_count": counts.vectors, "items_without_fulltext": counts.bare or 0, "status_breakdown": breakdown,
            "model_name": self.embedder.name, "model_dim": self.embedder.dim, "last_sync": meta.last_sync if meta else "", "data_dir": self.store.root,
        }

    def issues(self) -> DataFrame:
        titles = self.store.table("chunks").where("chunk_type = 'metadata'")
        return catalog.issues(self.store.table("status"), titles)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.store.table("chunks").where(F.col("chunk_id") == chunk_id).limit(1)

    def item_chunks(self, key: str, limit: int = 1000) -> DataFrame:
        return self.store.table("chunks").where(F.col("item_key") == key).orderBy("i").limit(limit)

    def has_fulltext(self, key: str) -> bool:
        return not catalog.fulltext(self.store.table("chunks"), key).isEmpty()

    def title_of(self, key: str) -> str | None:
        row = self.store.table("chunks").where((F.col("item_key") == key) & (F.col("chunk_type") == "metadata")).select("title").first()
        return row.title if row else None

    def status_of(self, key: str):
        return self.store.table("status").where(F.col("item_key") == key).first()
