"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors are brought to length 1, where a cosine is a distance: |a - b|^2 = 2 - 2 cos. Each of T tables hashes a vector
by k random projections (normal, so 2-stable) moved by a random offset and cut into steps of `width`. k follows the
number of vectors, so that a bucket's size doesn't; T follows k, so that two vectors at the threshold meet in some
table with probability `recall`. Vectors that share a bucket are compared exactly, in double. Each pair counts in the
first table in which it meets, which the other tables' hashes tell, so links are counted without listing pairs.
Buckets that are large all the same are cut into blocks whose pairs meet in separate tasks; none is capped.

Equal vectors are one node, with the number of its copies. A task emits the number of links of each vector and stars of
its groups, never all pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even with
equal ones; each is its own component. Only vectors of the same length are compared. A null vec_id links and counts,
but can't name a component unless all are null. Repeated ids are separate vectors. Vectors are told apart by 128 bits of
hashes. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_tasks, components, fresh, merge_labels, over_runs, stored

BUCKET = 4096
WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at this distance fall into the same step of one projection."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections of a table, tables)."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * cosine))
    k = max(1, math.ceil(math.log(max(n / BUCKET, 1)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _hashes(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket hashes."""
    rng = np.random.default_rng([unit.shape[1], k, tables])
    lines, moves = rng.standard_normal((unit.shape[1], k * tables)), rng.random(k * tables) * WIDTH
    steps = np.floor((unit @ lines + moves) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    weights = rng.integers(-(2**63), 2**63, size=(1, 1, k), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        mixed = (steps * weights).sum(axis=2)
        mixed ^= mixed >> 29
    return mixed


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares stay finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _packed(m: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that holds all its values exactly; the first byte is the width of a value."""
    with np.errstate(over="ignore"):
        single = m.astype(np.float32)
    exact = (single == m).all(axis=1)
    return [b"\4" + single[i].tobytes() if exact[i] else b"\x08" + m[i].tobytes() for i in range(len(m))]


def _unpacked(rows: list[bytes]) -> np.ndarray:
    """Rows of one length, in double precision."""
    if all(r[0] == 4 for r in rows):
        return np.frombuffer(b"".join(r[1:] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return np.array([np.frombuffer(r, np.float32 if r[0] == 4 else np.float64, offset=1) for r in rows], dtype=np.float64)


def buckets(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """(bucket, node, copies, table, hashes, vec) for each table of each node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies, vecs, dims = (batch.column(i) for i in range(4))
            dims = dims.to_numpy()
            for dim in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == dim), -(-int((dims == dim).sum()) // 1024)):
                    at = pa.array(rows)
                    m = _matrix(vecs.take(at), len(rows))
                    found = _hashes(_unit(m), k, tables)
                    short = (found >> 32).astype("<i4")  # tells tables' buckets apart, but for one pair in 2^32
                    packed = pa.array(_packed(m), pa.binary())
                    for t in range(tables):
                        with np.errstate(over="ignore"):
                            key = found[:, t] * np.int64(1_000_003) + t * 8191 + int(dim)
                        before = pa.array([short[i, :t].tobytes() for i in range(len(rows))], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), node.take(at), copies.take(at), before, packed], names=["bucket", "node", "copies", "earlier", "vec"]
                        )

    return nodes.select("node", "copies", "vec", "dim").mapInArrow(each, "bucket long, node long, copies long, earlier binary, vec binary")


def _compare(cosine: float):
    def work(table: pa.Table) -> pa.Table | None:
        n = table.num_rows
        if n < 2:
            return None
        node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
        raw, earlier = table["vec"].to_pylist(), table["earlier"].to_pylist()
        kinds = [(len(v) // v[0], len(e)) for v, e in zip(raw, earlier, strict=True)]
        if len(set(kinds)) > 1:  # buckets of other tables or lengths under an equal key
            keep = np.array([list(dict.fromkeys(kinds)).index(x) for x in kinds])
            parts = [work(table.filter(pa.array(keep == x))) for x in np.unique(keep)]
            parts = [p for p in parts if p is not None]
            return pa.concat_tables(parts) if parts else None
        m = _unit(_unpacked(raw))
        tables = len(earlier[0]) // 4
        before = np.frombuffer(b"".join(earlier), dtype="<i4").reshape(n, tables)
        whole = table["lo"][0].as_py() == table["hi"][0].as_py()
        left = np.arange(n) if whole else np.flatnonzero(side == table["lo"][0].as_py())
        right = left if whole else np.flatnonzero(side == table["hi"][0].as_py())
        links = np.zeros(n, dtype=np.int64)

        def pairs():
            for begin in range(0, len(left), 256):
                rows = left[begin : begin + 256]
                hit = m[rows] @ m[right].T >= cosine
                if whole:
                    hit &= right[None, :] > rows[:, None]
                i, j = np.nonzero(hit)
                if len(i) and tables:
                    new = ~(before[rows[i]] == before[right[j]]).any(axis=1)
                    i, j = i[new], j[new]
                np.add.at(links, rows[i], copies[right[j]])
                np.add.at(links, right[j], copies[rows[i]])
                ends = np.flatnonzero(np.diff(i)) + 1
                for own in np.split(np.arange(len(i)), ends):
                    if len(own):
                        yield int(rows[i[own[0]]]), right[j[own]]

        label = merge_labels(n, pairs())
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "to": node[label[some]]})

    return work


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    x = F.col("vec")
    usable = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = fresh(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    # -0.0 and 0.0 are one value. Two hashes by different seeds tell vectors apart; they cost one pass over the components.
    rows = rows.withColumn("vec", F.when(usable, F.transform(x, lambda v: v + F.lit(0.0))))
    rows = rows.withColumns({"h1": F.when(x.isNotNull(), F.xxhash64(x)), "h2": F.when(x.isNotNull(), F.xxhash64(F.lit(1), x))})
    nodes = rows.where(x.isNotNull()).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value("vec").alias("vec"))
    nodes = stored(nodes.select("h1", "h2", F.xxhash64("h1", "h2").alias("node"), "copies", "first", "vec", F.size("vec").alias("dim")), "nodes")
    k, tables = parameters(nodes.count(), cosine, recall)
    dealt = block_tasks(stored(buckets(nodes, k, tables), "buckets"), "bucket", "node", BUCKET)
    found = over_runs(dealt.select("task", "node", "copies", "side", "lo", "hi", "earlier", "vec"), "task", _compare(cosine), "node long, links long, `to` long")
    found = stored(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = stored(components(found, "node", "to").withColumnRenamed("node", "member"), "groups")
    linked = stored(nodes.select("node", "first").join(groups, F.col("node") == F.col("member")).select("node", "first", "component"), "linked")
    least = stored(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    moved = linked.join(least, "component").select("node", "least")
    known = nodes.select("h1", "h2", "node", "copies", "first").join(counts, "node", "left").join(moved, "node", "left")
    known = stored(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id")), "known")
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
