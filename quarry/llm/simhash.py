"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly by vantage-point trees.

Fingerprints: A-Z in lower case, words parted by ASCII white space, shingles of `shingle` words joined by spaces,
repeats included (fewer words: the whole sequence), XXH64 with seed 42; a bit is set if it is set in over half of them.

Links: equal fingerprints are one node. Two that differ in up to `radius` = 3 bits differ in at most one bit of their
upper or of their lower half (pigeonhole), so there is a vantage-point tree over each half, by the Hamming distance of
that half, a metric, with the radius 1. All nodes of a level share one vantage point, a fixed pseudo-random word, and
one bound, so that a tree is a list of words, needs no training and no broadcast, and deals fingerprints to 2^depth
shards. A fingerprint goes inside if its distance is at most bound + 1, outside if it is more than bound: by the
triangle inequality two fingerprints within distance 1 meet on one side, and only those at bound + 1 are copied to both
sides; all other branches are pruned. The depth follows the number of fingerprints, so a shard's size does not. Within a shard
fingerprints are sorted by their distance to another vantage point, and each block of them is compared only with
those within the radius of its range of distances. Shards that are large all the same (a family of near copies) are
cut into blocks whose pairs meet in separate tasks; none is capped.

A task emits links as stars to the smallest fingerprint of each of its groups, never all pairs; components are then
found by grouped aggregation.

Edge cases: null, empty or blank texts have the fingerprint zero and link like any other. A null doc_id takes part
but can't name a component unless all are null. Repeated rows each give a row. keep_one passes all columns through,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_tasks, components, fresh, merge_labels, nested, over_runs, stored, trim_memory

SEED = 42
HALF_RADIUS = 1
BOUND = 15  # of 32 bits: as many are at most 16 away from any word as are more than 15 away
SHRINK = 0.57  # the share of each side at that bound
SHARD = 512
LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    counts = np.zeros((8, 8), dtype=np.int64)  # [byte, bit]
    for begin in range(0, len(hashes), 255):
        part = hashes[begin : begin + 255]
        for bit in range(8):  # eight counters, one for each byte, in a word; 255 fit
            word = np.add.reduce(part >> np.uint64(bit) & LOW_BITS)
            counts[:, bit] += np.frombuffer(word.astype("<u8").tobytes(), dtype=np.uint8)
    bits = counts.ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                fp = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        trim_memory()

    rows = fresh(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def vantage(level: int, half: int) -> int:
    """The vantage point of a level of the tree over a half."""
    return xxhash.xxh64_intdigest(f"vantage {half} {level}".encode(), SEED) & 0xFFFFFFFF


def depth_for(n: int) -> int:
    return max(0, math.ceil(math.log(max(n, 1) / SHARD) / -math.log(SHRINK)))


def route(fps: np.ndarray, half: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each shard of the tree that a fingerprint belongs to; a shard is a path, a bit for each level."""
    words = (fps >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    row, path = np.arange(len(fps)), np.full(len(fps), half, dtype=np.uint64)
    for level in range(depth):
        far = np.bitwise_count(words[row] ^ np.uint32(vantage(level, half)))
        inside, outside = far <= BOUND + HALF_RADIUS, far > BOUND
        row = np.concatenate([row[inside], row[outside]])
        path = np.concatenate([path[inside] << np.uint64(1), path[outside] << np.uint64(1) | np.uint64(1)])
    return row, path


def shards(nodes: DataFrame, depth: int) -> DataFrame:
    """(fp, shard): every fingerprint in every shard of both trees that it may have neighbours in."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for begin in range(0, len(fps), 20_000):
                own = fps[begin : begin + 20_000]
                for half in (0, 1):
                    row, path = route(own, half, depth)
                    shard = path << np.uint64(1) | np.uint64(half)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row].view(np.int64)), pa.array(shard.view(np.int64))], names=["fp", "shard"])

    return nodes.select("fp").mapInArrow(each, "fp long, shard long")


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): a[i] is within radius of each of these; of b if given, else of a's own later ones.

    Sorted by distance to a vantage point, so that each block meets only those whose distance allows a link.
    """
    point = np.uint64(xxhash.xxh64_intdigest(b"vantage within", SEED))
    other = a if b is None else b
    near, far = np.bitwise_count(a ^ point).astype(np.int64), np.bitwise_count(other ^ point).astype(np.int64)
    order, others = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    far = far[others]
    for begin in range(0, len(a), 128):
        rows = order[begin : begin + 128]
        lo, hi = np.searchsorted(far, near[rows[0]] - radius), np.searchsorted(far, near[rows[-1]] + radius, side="right")
        if b is None:
            lo = max(lo, begin)
        columns = others[lo:hi]
        hit = np.bitwise_count(a[rows][:, None] ^ other[columns][None, :]) <= radius
        for i in np.flatnonzero(hit.any(axis=1)):
            yield int(rows[i]), columns[hit[i]]


def _links(radius: int):
    def work(table: pa.Table) -> pa.Table | None:
        fps = table["fp"].to_numpy().view(np.uint64)
        side = table["side"].to_numpy()
        if table["lo"][0].as_py() == table["hi"][0].as_py():
            label = merge_labels(len(fps), close_pairs(fps, None, radius))
        else:
            a, b = np.flatnonzero(side == table["lo"][0].as_py()), np.flatnonzero(side == table["hi"][0].as_py())
            label = merge_labels(len(fps), ((a[i], b[js]) for i, js in close_pairs(fps[a], fps[b], radius)))
        apart = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": fps[apart].view(np.int64), "b": fps[label[apart]].view(np.int64)})

    return work


def near_duplicates(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for the rows of fingerprints(); component_id is the smallest doc_id reachable."""
    if radius > 2 * HALF_RADIUS + 1:
        raise ValueError("two halves with one differing bit each cover a radius of up to 3")
    prints = stored(prints, "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    depth = depth_for(nodes.count())
    tasks = block_tasks(stored(shards(nodes, depth), "shards"), "shard", "fp", SHARD)
    links = over_runs(tasks.select("task", "fp", "side", "lo", "hi"), "task", _links(radius), "a long, b long")
    found = stored(components(links), "components")
    # What is aggregated is stored before it is joined back, so that joins with a hot component or fingerprint can be split.
    linked = stored(nodes.join(found, nodes.fp == found.node).select("fp", "first", "component"), "linked")
    least = stored(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    moved = linked.join(least, "component").select("fp", "least")
    ids = nodes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(stored(ids, "ids"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The row of docs whose id names its component. Of rows that share an id, each distinct text counts as one."""
    found = near_duplicates(fingerprints(docs, id_col, text_col), radius)
    found = stored(found.select(F.col("doc_id").alias("dropped_id_"), F.col("component_id").alias("name_")), "found")
    names = found.select("name_").distinct()
    # The ids that go are far fewer than those that stay: where they are few enough, AQE sends them to the texts, and
    # only else moves the texts to them.
    dropped = stored(found.select("dropped_id_").distinct().join(names, F.col("dropped_id_").eqNullSafe(F.col("name_")), "left_anti"), "dropped")
    rows = nested(docs, id_=F.col(f"`{id_col}`"))
    kept = rows.join(dropped, F.col("id_").eqNullSafe(F.col("dropped_id_")), "left_anti")
    shared = stored(rows.groupBy("id_").count().where("count > 1").select(F.col("id_").alias("shared_id_")), "shared")
    if shared.isEmpty():
        return kept.select("row_.*")
    same = F.col("id_").eqNullSafe(F.col("shared_id_"))
    twice = kept.join(shared, same, "left_semi").withColumn("text_", F.col(f"row_.`{text_col}`")).dropDuplicates(["id_", "text_"])
    return kept.join(shared, same, "left_anti").select("row_.*").unionByName(twice.select("row_.*"))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
