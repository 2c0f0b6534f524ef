"""Shared plumbing: scratch tables, record batches, bounded block joins and connected components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, scratch, shared_dir


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and outlives any executor.

    The table belongs to the DataFrames made from it, until release().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # What a finished write has shuffled isn't read again: its files go at once, not when the driver collects garbage.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(key, setting)
    return spark.read.schema(df.schema).parquet(path)


def nested(df: DataFrame, **own) -> DataFrame:
    """df's columns in one struct row_, beside an operator's own ones, so that names can't clash; unnest by select("row_.*")."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"), *[c.alias(n) for n, c in own.items()])


def fresh(df: DataFrame, *used: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns can't reach an operator's own names."""
    return df.select(*[F.col(f"`{c}`") for c in used])


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, whose texts are about to go to Python: a session that sends 10,000 rows at once is set to fewer, as texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def trim_memory() -> None:
    """Give what a worker has freed back to the system: workers are kept between tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_bucket_py(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys; the partition must be sorted by key, and a key's rows must fit in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for begin, end in zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True):
            if held and keys[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = keys[begin]
    if held:
        yield pa.Table.from_batches(held)


def over_runs(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table | None], schema: str, partitions: int | None = None) -> DataFrame:
    """work() on the rows of each key, one key at a time."""
    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)

    def each(batches):
        for table in runs(batches, key):
            out = work(table)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

    return dealt.sortWithinPartitions(key).mapInArrow(each, schema)


def block_tasks(keyed: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Deal the rows of each key to tasks of at most about two blocks in which every pair of a key's rows meets.

    A key of up to 2 * block rows is one task. A larger one is cut by a hash of ident into g blocks, and the task
    (i, j) gets the blocks i and j: g copies of each row, and no task grows with the key. A row carries `side`: its
    block; tasks with i < j compare only rows of different blocks, so that each pair of rows meets exactly once.
    Adds: task (long), lo, hi, side (int; lo = hi = side = 0 for whole keys).
    """
    sizes = keyed.groupBy(key).agg(F.count("*").alias("rows_")).where(F.col("rows_") > 2 * block)
    sizes = stored(sizes.select(F.col(key).alias("hot_"), F.ceil(F.col("rows_") / block).cast("int").alias("g_")), "hot")
    joined = keyed.join(sizes, F.col(key) == F.col("hot_"), "left").drop("hot_")
    side = F.coalesce(F.pmod(F.xxhash64(ident, F.lit("side")), F.col("g_")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g_"), F.lit(1)) - 1))
    return (
        joined.withColumn("side", side)
        .withColumn("other_", other)
        .withColumn("lo", F.least("side", "other_"))
        .withColumn("hi", F.greatest("side", "other_"))
        .withColumn("task", F.xxhash64(key, "lo", "hi"))
        .drop("g_", "other_")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges.

    Alternates large-star and small-star steps, each a grouped aggregation written to the shared folder, until the
    edges form stars. The minimum of each node's neighbours is aggregated before the shuffle and stored, so that the join
    that brings it back to the neighbours is a plain one, which AQE splits where a hub has very many.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "edges")
        # Stars: no node is both a hub and a leaf, and each leaf has one hub.
        done = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("k")).first()
        if done.n == done.k and new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            leaves = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = new


def merge_labels(n: int, links: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Labels 0..n-1 after linking each row with the columns given for it; the label is the smallest row of its set."""
    label = np.arange(n)
    for row, columns in links:
        found = np.unique(np.append(label[columns], label[row]))
        if len(found) > 1:
            label[np.isin(label, found[1:])] = found[0]
    return label
