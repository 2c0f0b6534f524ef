"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair whose joined bytes have a rank waits in the bucket of that
rank, by position. Bitmaps of 256-bit words over the ranks, two levels deep, say which buckets hold entries:
find-first-set on each level gives the lowest rank in constant time, whatever the length of the pre-token. Within a
bucket the leftmost position goes first. Entries whose pair has changed since are stale and skipped when met. Each
merge costs O(log n) at most, where scanning all pairs would cost O(n).

Edge cases: a null text counts as empty and gives no ids. Texts are taken whole, of any length. Every single byte must
have a rank, so that each text can be encoded; decoding the ids gives back the text's bytes. Rows, ties and repeated
rows are independent of each other; other columns pass through untouched unless they bear an output name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import compress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split import splitter

CACHE_ENTRIES = 300_000
CACHED_CHARS = 40


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, by 256 * first + second; -1 where there is none."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one pre-token.

    The queue is kept in local variables, as a call for each entry would cost more than the entry: buckets (rank to
    positions, a heap), low (256 ranks to a bitmap of those whose bucket holds entries), top (a bitmap over low).
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; parts are linked by their bounds
    before = list(range(-1, n - 1))
    pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the pair that begins here
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank >= 0:
            bucket = buckets.get(rank)
            if bucket:
                bucket.append(i)
            else:
                buckets[rank] = [i]
                h = rank >> 8
                low[h] = low.get(h, 0) | 1 << (rank & 255)
                top |= 1 << h
    get = ranks.get
    while top:
        h = (top & -top).bit_length() - 1
        word = low[h]
        rank = h << 8 | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket.pop()
            low[h] = word = word & word - 1
            if not word:
                top &= top - 1
        if pair[i] != rank:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        pair[j] = -1
        changed = [(i, -1)]
        if k < n:
            before[k] = i
            changed = [(i, get(piece[i : end[k]], -1))]
        at = before[i]
        if at >= 0:
            new = get(piece[at:k], -1)
            if new != pair[at]:
                changed.append((at, new))
        for at, new in changed:
            pair[at] = new
            if new >= 0:
                bucket = buckets.get(new)
                if bucket:
                    heappush(bucket, at)
                else:
                    buckets[new] = [at]
                    h = new >> 8
                    low[h] = low.get(h, 0) | 1 << (new & 255)
                    top |= 1 << h
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class Codec:
    """Encodes and decodes by a vocabulary of ranks; keeps short pre-tokens it has met, up to a fixed count."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, splitter(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs = pair_table(ranks)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was met before the cache was last full

    def _piece(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("I", merge(piece.encode(), self.ranks, self.pairs)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache, self.older = {}, self.cache
            self.cache[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.find(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            for i in compress(range(len(found)), [x is None for x in found]):
                found[i] = self.cache.get(pieces[i]) or self._piece(pieces[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; the vocabulary is a file that every machine has, as the library it comes with."""
    with open(path, "rb") as f:
        return Codec(read_ranks(f.read()), pattern)


def _mapped(df: DataFrame, steps: list[tuple[str, str, Callable[[], Callable]]]) -> DataFrame:
    """df with the target of each (source, target, function's maker), all in one Python stage; a step may read an earlier target."""
    targets = [target for _, target, _ in steps]
    kept = [c for c in df.columns if c not in targets]
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType([*fields, *(T.StructField(t, T.BinaryType()) for t in targets)])
    sources = df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = [(source, target, make()) for source, target, make in steps]
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                made: dict[str, list] = {}
                for source, target, convert in work:
                    values = made[source] if source in made else part.column(sources.index(source)).to_pylist()
                    made[target] = [convert(x) for x in values]
                columns = [part.column(sources.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[t], pa.binary()) for t in targets)], names=schema.names)

    return df.mapInArrow(each, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: the ids of text_col, packed as little-endian unsigned 32-bit integers (binary)."""
    return _mapped(df, [(text_col, ids_col, lambda: codec(vocabulary, pattern).encode)])


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col: the bytes that the packed ids of ids_col stand for. Null ids count as none."""
    return _mapped(df, [(ids_col, bytes_col, lambda: codec(vocabulary, pattern).decode)])


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encode() and decode() by the same workers: one vocabulary and cache for each core instead of two."""
    return _mapped(df, [(text_col, ids_col, lambda: codec(vocabulary, pattern).encode), (ids_col, bytes_col, lambda: codec(vocabulary, pattern).decode)])


def id_count(ids_col: str = "ids"):
    return (F.octet_length(F.col(ids_col)) / 4).cast("long")


def unpack(packed: pa.Array) -> pa.Array:
    """Packed ids as a list array, for callers outside Spark."""
    return pa.array([memoryview(x).cast("I").tolist() if x else [] for x in pc.fill_null(packed, b"").to_pylist()], pa.list_(pa.uint32()))
