r"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z in lower case. In
UTF-8 these are runs of bytes, so a text is split as bytes. The impact of a term in a document is a 64-bit integer,
w * ((10^9 * tf) div (1000 * tf + 12 * m)), from the term's weight w and the document's length factor m; a document's
score for an item is the sum of its terms' impacts, each times how often the item has the term.

The items are dealt to blocks of at most `block` term occurrences, each a sparse matrix of bounded size, which is what is
broadcast. For a block, one pass over the documents stores the sparse rows of those terms that the block has, beside
each document's length. Statistics (documents, terms, document frequencies) are grouped sums over that table. A second pass
multiplies: a task takes its documents in blocks, turns each block's entries into rows by term, and merges for every
item the rows of its terms into one dense row of int64 (Gustavson's algorithm; a term's row has each document once, so
that an indexed addition is exact). The k best of each block are merged into the task's lists, and the tasks' lists
in groups of `fan`, level by level. Documents are never shuffled, and no task grows with a term's frequency.

Edge cases: a null text, or one without a term, is no document: it doesn't count in N, and is never found; an item like
that has no rows. Each row of documents is a document and each row of items an item of its own, also where ids or whole
rows repeat. Equal scores go by the smaller document id, a null id last. Texts are taken whole. Other columns are left
out, whatever their names. Empty tables give no rows. A score beyond a long can't come up below 10^8 terms in an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, text_batches

#: Entries of documents that a product holds at once.
ENTRIES = 1 << 20
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEEP else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(_TABLE).split()


@dataclass
class Items:
    """A block of items: their terms as a matrix in compressed rows, columns by first occurrence in the block."""

    terms: dict[bytes, int]
    starts: np.ndarray
    columns: np.ndarray
    counts: np.ndarray


def matrix(texts: list[bytes | None]) -> Items:
    terms: dict[bytes, int] = {}
    starts, columns, counts = [0], [], []
    for text in texts:
        for term, n in Counter(terms_of(text)).items():
            columns.append(terms.setdefault(term, len(terms)))
            counts.append(n)
        starts.append(len(columns))
    return Items(terms, np.array(starts), np.array(columns, dtype=np.int64), np.array(counts, dtype=np.int64))


def blocks_of(items: DataFrame, block: int) -> Iterator[list]:
    """The items' rows, in lists of at most `block` occurrences of terms (an item of more is alone), read as an iterator."""
    held, size = [], 0
    for row in items.toLocalIterator():
        n = len(terms_of(row.text_))
        if held and size + n > block:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def rows_of(documents: DataFrame, terms) -> DataFrame:
    """(id, n, term array<int>, tf array<int>): documents with a term, and the entries of those in terms (a broadcast dict)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = terms.value.get
        for batch in batches:
            sizes, columns, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                found, n = np.unique([i for i in map(place, words) if i is not None], return_counts=True)
                columns.append(found.astype(np.int32))
                counts.append(n.astype(np.int32))
            keep = pa.array([n > 0 for n in sizes], pa.bool_())
            offsets = pa.array(np.r_[0, np.cumsum([len(c) for c in columns])], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *x]))) for x in (columns, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "term", "tf"]).filter(keep)

    return documents.mapInArrow(each, "id long, n long, term array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits could overflow."""
    if len(n) and 25 * int(n.max()) * n_docs >= 2**63:
        return np.array([75 + 25 * x * n_docs // total for x in n.tolist()], dtype=np.int64)
    return 75 + 25 * n * n_docs // total


def product(items: Items, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """A dense row of scores for each item, over documents 0..len(m)-1, from entries (doc, term, tf)."""
    tf = tf.astype(np.int64)
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    at = np.searchsorted(term[order], np.arange(len(weights) + 1))
    for begin, end in zip(items.starts[:-1], items.starts[1:], strict=True):
        row = np.zeros(len(m), dtype=np.int64)
        for t, times in zip(items.columns[begin:end].tolist(), items.counts[begin:end].tolist(), strict=True):
            own = slice(at[t], at[t + 1])
            row[doc[own]] += times * impact[own]
        yield row


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties to the smaller id."""
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        edge = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= edge]
    found = found[np.lexsort((ids[found], -score[found]))][:k]
    return score[found], ids[found]


#: Stands for a null document id inside a product, after all others.
NO_ID = np.iinfo(np.int64).max


def top_of(rows: DataFrame, shared, k: int) -> DataFrame:
    """(shard, item int, id, score): the k best documents of each task for each item of shared: (Items, weights, N, L)."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= ENTRIES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, total = shared.value
        lists = [(np.empty(0, np.int64), np.empty(0, np.int64))] * (len(items.starts) - 1)
        for table in grouped(batches):
            if not table.num_rows:
                continue
            ids = table["id"].fill_null(NO_ID).to_numpy()
            term, tf = (pa.chunked_array(table[c].chunks).combine_chunks() for c in ("term", "tf"))
            doc = np.repeat(np.arange(len(ids)), term.value_lengths().to_numpy())
            m = length_factor(table["n"].to_numpy(), n_docs, total)
            for i, score in enumerate(product(items, weights, doc, term.flatten().to_numpy(), tf.flatten().to_numpy(), m)):
                own, found = best(score, ids, k)
                if len(own):
                    lists[i] = best(np.r_[lists[i][0], own], np.r_[lists[i][1], found], k)
        item = np.repeat(np.arange(len(lists)), [len(s) for s, _ in lists])
        score, found = (np.concatenate([np.empty(0, np.int64), *[x[c] for x in lists]]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return rows.mapInArrow(each, "item int, id long, score long").withColumn("shard", F.spark_partition_id())


def ranked(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group, with rank; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = 1 << 20, fan: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item."""
    spark = documents.sparkSession
    documents = text_batches(fresh(documents, doc_id, text).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text_")))
    asked = fresh(items, item_id, text).select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text_"))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = []
    for rows in blocks_of(asked, block):
        own = matrix([r.text_ for r in rows])
        if not own.terms:
            continue
        entries = stored(rows_of(documents, spark.sparkContext.broadcast(own.terms)), "entries")
        total = entries.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            continue
        # A row for each term of the block at most.
        df = entries.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        weights = np.zeros(len(own.terms), dtype=np.int64)
        for r in df:
            weights[r.term] = weight(total.n, r.df)
        shared = spark.sparkContext.broadcast((Items({}, own.starts, own.columns, own.counts), weights, total.n, total.l))
        lists = top_of(entries, shared, k)
        shards = entries.rdd.getNumPartitions()
        while shards > fan:
            shards = -(-shards // fan)
            lists = ranked(lists.withColumn("shard", F.floor(F.col("shard") / fan)), ["item", "shard"], k).drop("rank")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found = ranked(lists, ["item"], k).join(F.broadcast(names), "item")  # at most a block's items
        out.append(stored(found.select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score"), "hits"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
