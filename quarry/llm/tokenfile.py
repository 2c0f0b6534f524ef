"""Token-id files: documents' ids in ascending id order, packed by Simple-8b word-aligned coding.

A segment holds the ids of some neighbouring documents:

    magic "QS8B1\\0\\0\\0", then as little-endian unsigned 64-bit: documents, ids, blocks, words of counts, words of ids
    first word of each block (32-bit, padded to 8 bytes)
    words: the documents' lengths, then the ids

A word has a selector in its upper 4 bits and `count` values of `width` bits below, first value lowest. Selector 0 is
the escape: the next word is one whole value of 60 bits or more. Each block of 128 values begins with a word of its
own, and the block offsets let a reader decode any block alone, or all of them at once: all words of a selector are
unpacked together.

Segments are rows of a Parquet table (file, segment, start, n_docs, n_ids, doc_ids, payload), which gives atomic
commits and works in any store that Spark reads. Files are ranges of doc_id, so the order (file, segment) is ascending.

Edge cases: a null text counts as empty (the end id alone); null doc_ids come first; equal doc_ids follow one another
in the order of their texts' hashes; an empty table gives a file set without rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import fresh

MAGIC = b"QS8B1\0\0\0"
BLOCK = 128
#: Fixed values of the coding: values per word, by selector from 1; the width is 60 // count.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SEGMENT = "file int, segment int, start long, n_docs int, n_ids long, doc_ids array<long>, payload binary"


def _selectors(bits: np.ndarray) -> np.ndarray:
    """The selector of the longest run that fits, for each place of each block; bits is padded with 255."""
    n = BLOCK
    run = {1: bits}
    for k in range(2, 9):
        run[k] = np.maximum(run[k - 1][:, :-1], bits[:, k - 1 :])
    for k, (a, b) in {10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}.items():
        size = bits.shape[1] - k + 1
        run[k] = np.maximum(run[a][:, :size], run[b][:, a : a + size])
    out = np.zeros((len(bits), n), dtype=np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        out[run[COUNTS[s]][:, :n] <= WIDTHS[s]] = s
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit values."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    bits = np.full((blocks, BLOCK + 60), 255, dtype=np.uint8)
    width = np.zeros(blocks * BLOCK, dtype=np.uint8)
    high = values >> np.uint64(32)
    wide = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # exact below 2^53
    if high.any():
        big = np.flatnonzero(high)
        wide[big] = 32 + np.frexp(high[big].astype(np.float64))[1]
    width[:n] = wide
    width[n:] = 255
    bits[:, :BLOCK] = width.reshape(blocks, BLOCK)
    selector = _selectors(bits)
    begins = np.zeros((blocks, BLOCK), dtype=bool)
    at, row = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    step = COUNTS.copy()
    step[0] = 1
    while len(row):
        begins[row, at] = True
        at = at + step[selector[row, at]]
        going = at < length[row]
        row, at = row[going], at[going]
    where = np.flatnonzero(begins.ravel())
    chosen = selector.ravel()[where]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[own] + 1] = values[where[own]]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        word = np.full(len(own), int(s) << 60, dtype=np.uint64)
        for j in range(c):
            word |= values[where[own] + j] << np.uint64(j * w)
        words[place[own]] = word
    offsets = place[np.searchsorted(where, np.arange(blocks) * BLOCK)].astype(np.uint32)
    return words, offsets


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of words."""
    top = (words >> np.uint64(60)).astype(np.int64)
    escape = np.flatnonzero(top == 0)
    real = np.ones(len(words), dtype=bool)
    if len(escape):
        real[escape + 1] = False  # a raw value has 60 bits or more, so it never looks like an escape itself
    where = np.flatnonzero(real)
    chosen = top[where]
    count = COUNTS[chosen]
    count[chosen == 0] = 1
    start = np.cumsum(count) - count
    out = np.empty(n, dtype=np.uint64)
    for s in np.unique(chosen):
        own = chosen == s
        if s == 0:
            out[start[own]] = words[where[own] + 1]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        held, first, mask = words[where[own]], start[own], np.uint64((1 << w) - 1)
        for j in range(c):
            out[first + j] = held >> np.uint64(j * w) & mask
    return out


def decode_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block alone, by its offset."""
    n_docs, n_ids, blocks, n_counts, n_words = struct.unpack_from("<5Q", payload, 8)
    offsets = np.frombuffer(payload, "<u4", blocks, 48)
    words = np.frombuffer(payload, "<u8", n_words, 48 + -(-4 * blocks // 8) * 8 + 8 * n_counts)
    end = int(offsets[block + 1]) if block + 1 < blocks else n_words
    return decode(words[int(offsets[block]) : end], min(BLOCK, n_ids - block * BLOCK))


def to_segment(counts: np.ndarray, ids: np.ndarray) -> bytes:
    length_words, _ = encode(counts.astype(np.uint64))
    words, offsets = encode(ids.astype(np.uint64))
    head = struct.pack("<5Q", len(counts), len(ids), len(offsets), len(length_words), len(words))
    index = offsets.astype("<u4").tobytes()
    return MAGIC + head + index + b"\0" * (-len(index) % 8) + length_words.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def from_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each document, ids)."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token-id segment")
    n_docs, n_ids, blocks, n_counts, n_words = struct.unpack_from("<5Q", payload, 8)
    at = 48 + -(-4 * blocks // 8) * 8
    counts = decode(np.frombuffer(payload, "<u8", n_counts, at), n_docs)
    return counts, decode(np.frombuffer(payload, "<u8", n_words, at + 8 * n_counts), n_ids)


def write(docs: DataFrame, path: str, vocabulary: str, pattern: str, lower: bool = True, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, segment_ids: int = 1 << 19) -> None:
    """Encode text_col, close each document with end_id, and write the files to path, ascending by id_col."""
    end = end_id.to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, pattern, lower)
        file, number, start = TaskContext.get().partitionId(), 0, 0
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def segment():
            nonlocal held_ids, held, size, number, start
            counts = np.array([len(x) // 4 for x in held], dtype=np.uint64)
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = [file, number, start, len(counts), len(ids), held_ids, to_segment(counts, ids)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["file", "segment", "start", "n_docs", "n_ids", "doc_ids", "payload"])
            number, start = number + 1, start + len(ids)
            held_ids, held, size = [], [], 0
            return out

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    held_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield segment()
        if held:
            yield segment()

    rows = fresh(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).mapInArrow(each, SEGMENT)
    out.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)  # packed already


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at path; start counts the ids of all documents before."""
    table = spark.read.schema(SEGMENT).parquet(path)
    base, total = {}, 0
    for r in table.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect():  # a row for each file
        base[r.file], total = total, total + r.n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, doc_ids, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                counts, ids = from_segment(payload)
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts.astype(np.int64)
                packed = ids.astype("<u4").tobytes()
                own = [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + (base[file] + start)), pa.array(counts.astype(np.int64)), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return table.select("file", "start", "doc_ids", "payload").mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")
