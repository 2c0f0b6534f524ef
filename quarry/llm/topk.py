"""Exact top-k inner products: tiled matrix products of queries and row shards, merged as a tree.

Every vector becomes integers, floor(scale * x) with x as double. Queries are dealt to tiles and candidate rows to
shards, by hash. A task holds one tile and one shard: a matrix product per block of rows, a partial selection of the k
best per query, and a running merge. The lists of a query from all shards then merge in groups of `fan`, level by
level, so that no task ever holds the lists of a query from all shards.

Edge cases: a vector that is null, empty, or holds a null or non-finite component takes no part, neither as query nor
as candidate. Vectors of different lengths are never compared. A row is not its query's candidate if their ids are
equal, so repeated ids are left out as well; a null id takes no part. Each row of queries has a list of its own, also
where ids or whole rows repeat. Other columns of the tables are left out, whatever their names. Ties go to the smaller id. An empty table gives
no rows. Products are exact: double precision while all partial sums stay below 2^53, Python integers beyond that; a
score beyond a long raises OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, over_runs, stored

ROW_BLOCK = 4096


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, dim, vec): usable vectors as floor(scale * x) in double."""
    x = F.col("x_")
    usable = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        fresh(df, id_col, vec_col)
        .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x_"))
        .where(F.col("id").isNotNull() & x.isNotNull() & usable)
        .select("id", F.size(x).alias("dim"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec"))
    )


def _product(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    bound = np.abs(q).max() * np.abs(r).max() * q.shape[1]
    if bound < 2.0**53:
        return (q @ r.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    out = exact(q) @ exact(r).T
    if max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
        raise OverflowError("a score does not fit in a long")
    return out.astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the k best allowed entries of each row, ties to the smaller id."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, score, low)
    if score.shape[1] > k:
        edge = np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        allowed = allowed & (masked >= edge[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return row, ids[column], score[row, column]


def _tile_task(k: int):
    def work(table: pa.Table) -> pa.Table | None:
        is_query = table["is_query"].to_numpy()
        ids, copies, marks = (table[c].to_numpy() for c in ("id", "copies", "mark"))
        m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["vec"].chunks]).reshape(len(ids), -1)
        qid, q, copies, marks = ids[is_query], m[is_query], copies[is_query], marks[is_query]
        rid, r = ids[~is_query], m[~is_query]
        if not len(qid) or not len(rid):
            return None
        kept = [np.empty(0, np.int64)] * 3
        for at in range(0, len(rid), ROW_BLOCK):
            own = rid[at : at + ROW_BLOCK]
            row, found, score = best(_product(q, r[at : at + ROW_BLOCK]), own, own[None, :] != qid[:, None], k)
            row, found, score = (np.concatenate(x) for x in zip(kept, (row, found, score), strict=True))
            order = np.lexsort((found, -score, row))
            row, found, score = row[order], found[order], score[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            kept = [row[top], found[top], score[top]]
        shard = np.full(len(kept[0]), table["shard"][0].as_py(), dtype=np.int32)
        return pa.table({"query_id": qid[kept[0]], "mark": marks[kept[0]], "copies": copies[kept[0]], "vec_id": kept[1], "score": kept[2], "shard": shard})

    return work


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, tile: int = 2048, shard_rows: int = 32768, fan: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) for frames made by quantised(); every query against every row."""
    # Equal rows of queries are one query with a number of copies; mark tells those apart that only share their id.
    queries = queries.groupBy("id", "dim", "vec").agg(F.count("*").alias("copies")).withColumn("mark", F.xxhash64("vec"))
    queries = stored(queries, "queries")
    n_q, n_r = queries.count(), rows.count()
    tiles, shards = max(1, -(-n_q // tile)), max(1, -(-n_r // shard_rows))
    shards = max(shards, min(-(-n_r // 4096), -(-rows.sparkSession.sparkContext.defaultParallelism * 2 // tiles)))
    # A shard's rows go to every tile of queries, a tile's queries to every shard: tiles * shards tasks of bounded size.
    q = queries.withColumn("tile", F.pmod(F.xxhash64("id", "mark"), F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(True))
    r = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("is_query", F.lit(False))
    r = r.withColumns({"copies": F.lit(0).cast("long"), "mark": F.lit(0).cast("long")})
    both = q.unionByName(r).withColumn("task", F.xxhash64("tile", "shard", "dim")).select("task", "shard", "id", "mark", "copies", "is_query", "vec")
    lists = over_runs(both, "task", _tile_task(k), "query_id long, mark long, copies long, vec_id long, score long, shard int", max(tiles * shards, 1))
    query = ["query_id", "mark", "copies"]
    while shards > 1:
        shards = -(-shards // fan)
        lists = ranked(lists.withColumn("shard", (F.col("shard") / fan).cast("int")), [*query, "shard"], k).drop("rank")
    lists = ranked(lists, query, k)
    return lists.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def ranked(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group; Spark limits each group before the shuffle (WindowGroupLimit)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
