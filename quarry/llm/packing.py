"""Best-fit packing of documents into token sequences by bin-completion branch-and-bound.

A document longer than a sequence is cut into full pieces, its remainder being the first piece, so that only remainders
and shorter documents need packing. Lengths are whole numbers up to the capacity, so the corpus is summed up by how
many pieces there are of each length: a table of at most `capacity` rows, whatever the input. On it the planner takes
the longest length left and looks for the best filling of the room beside it: a branch-and-bound over completions by
descending length, pruned by the waste that remains at best, with the best-fit-decreasing filling as the first
incumbent. Dominated completions aren't enumerated where that can be told at once: of the pieces after which nothing
more fits, only the longest is tried; any other dominated one wastes more than the one that dominates it, so it never
becomes the incumbent in its place. The filling found is repeated as often as the counts allow. Full sequences can't be
improved on, and the incumbent keeps the search short; it is iterative, so no number of pieces is too deep for it. Where a
search has seen node_limit nodes without a full sequence, the branches that are left are bounded exactly: by the sums that any
of the pieces left can reach, as bits of one number, from which a filling of least waste is read off. So every filling is of
least waste, with any limit.

Pieces then find their places without meeting each other: the n-th piece of a length, counted from per-partition
counts, belongs to the plan entry whose range of n holds it.

Edge cases: a null text counts as empty; every document ends with end_id, so that none has length 0. Equal ids and
repeated rows are packed as separate documents. An empty table gives no rows. Other columns of the packed table pass
through, whatever their names; sequence_id and offset are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import fresh, nested, stored, trim_memory

GROUP = 1024
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, pattern: str, lower: bool = False, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = tokens.CACHE_ENTRIES) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and end_id, cut; ids as packed unsigned 32-bit."""
    end = end_id.to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, pattern, lower, cache_entries)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        for column, x in zip(rows, (doc_id, k, start, n, ids[4 * start : 4 * (start + n)]), strict=True):
                            column.append(x)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
        trim_memory()

    return fresh(docs, id_col, text_col).mapInArrow(each, PIECES)


class Completion:
    """Fillings of the room beside the longest piece, from a multiset of lengths."""

    def __init__(self, counts: dict[int, int], node_limit: int = 4000) -> None:
        self.counts = dict(counts)
        self.lengths = sorted(counts)
        self.node_limit = node_limit
        self.limited = 0  # fillings for which the limit was met

    def _best_fit(self, room: int) -> list[int]:
        """The longest piece that fits, again and again: the incumbent."""
        used: dict[int, int] = {}
        out, hi = [], len(self.lengths)
        while room and (hi := bisect.bisect_right(self.lengths, room, 0, hi)):
            x = self.lengths[hi - 1]
            if used.get(x, 0) < self.counts[x]:
                used[x] = used.get(x, 0) + 1
                out.append(x)
                room -= x
            else:
                hi -= 1
        return out

    def fill(self, room: int) -> list[int]:
        """A filling that wastes as little of room as any can."""
        best = self._best_fit(room)
        waste = room - sum(best)
        if not waste or not self.lengths:
            return best
        smallest, nodes = self.lengths[0], 0
        used: dict[int, int] = {}
        below = [0]  # tokens in all pieces of the shortest lengths
        for x in self.lengths:
            below.append(below[-1] + x * self.counts[x])

        # Depth first, without recursion: a frame is the room left, how many of the lengths may still be taken, and
        # whether a closing piece was tried; taken holds the piece that led to each frame but the first.
        frames: list[list] = [[room, bisect.bisect_right(self.lengths, room), False]]
        taken: list[int] = []
        while frames:
            left, hi, closed = frames[-1]
            piece = None
            while hi and left - below[hi] < waste:  # else even all that is left wastes as much as the best
                x = self.lengths[hi - 1]
                closes = left - x < smallest
                if used.get(x, 0) < self.counts[x] and not (closes and closed):
                    closed |= closes  # a longer closing piece dominates all shorter ones
                    piece = x
                    break
                hi -= 1
            if piece is None:
                frames.pop()
                if taken:
                    used[taken.pop()] -= 1
                continue
            # Back here the next shorter length is tried: fillings with more of this one lie below.
            frames[-1][1:] = [hi - 1, closed]
            used[piece] = used.get(piece, 0) + 1
            taken.append(piece)
            left -= piece
            nodes += 1
            if left < waste:
                best, waste = list(taken), left
            if not waste or nodes >= self.node_limit:
                if waste:
                    self.limited += 1
                    exact = self._reached(room)
                    best = exact if sum(exact) > room - waste else best
                break
            frames.append([left, bisect.bisect_right(self.lengths, left, 0, hi), False])
        return best

    def _reached(self, room: int) -> list[int]:
        """A filling of least waste from the sums that the pieces reach: bit s of a number stands for the sum s."""
        within, sums, lengths = (1 << room + 1) - 1, [1], []
        for x in self.lengths:
            if x > room or sums[-1] >> room & 1:
                break
            reach, rest, step = sums[-1], min(self.counts[x], room // x), 1
            while rest:  # any number of pieces of this length, by doubling
                step = min(step, rest)
                reach |= reach << x * step & within
                rest, step = rest - step, 2 * step
            sums.append(reach)
            lengths.append(x)
        out, left = [], sums[-1].bit_length() - 1
        for x, before in zip(reversed(lengths), reversed(sums[:-1]), strict=True):
            while not before >> left & 1:  # the sum needs one more of this length
                out.append(x)
                left -= x
        return out

    def take(self, pattern: list[int]) -> int:
        """Use the pattern as often as the counts allow; returns how often."""
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(self.counts[x] // n for x, n in need.items())
        for x, n in need.items():
            self.counts[x] -= times * n
            if not self.counts[x]:
                del self.counts[x]
                self.lengths.remove(x)
        return times


def plan(counts: dict[int, int], capacity: int, node_limit: int = 4000) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences), longest piece first; uses up all counts."""
    left = Completion(counts, node_limit)
    out = []
    while left.lengths:
        top = left.lengths[-1]
        left.counts[top] -= 1
        if not left.counts[top]:
            del left.counts[top]
            left.lengths.pop()
        rest = left.fill(capacity - top)
        if top not in left.counts:
            left.counts[top] = 0
            bisect.insort(left.lengths, top)
        left.counts[top] += 1
        pattern = [top, *rest]
        out.append((pattern, left.take(pattern)))
    return out


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first n of each entry, first sequence, offset of the first slot, slots of this length."""
    seen: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for x in dict.fromkeys(pattern):
            slots = pattern.count(x)
            table.setdefault(x, []).append((seen.get(x, 0), sequence, at, slots))
            seen[x] = seen.get(x, 0) + times * slots
            at += x * slots
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in table.items()}


def pack(found: DataFrame, capacity: int = 2048, node_limit: int = 4000) -> DataFrame:
    """The rows of found, a table with a column length from 1 to capacity, with sequence_id and offset.

    found is stored first, with the number of each row among those of its length in its partition; then no row needs
    to meet another one. Full pieces take no part in the search: each is a sequence.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(1).to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.empty(len(length), dtype=np.int64)
            place[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered)
            place += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            for begin in range(0, len(length), GROUP):
                size = len(length[begin : begin + GROUP])
                lists = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), x.slice(begin, size)) for x in (batch.column(0), batch.column(1), pa.array(place))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], names=["part", "rows", "lengths", "places"])

    rows = nested(found.drop("sequence_id", "offset"), length=F.col("length").cast("long"))
    row = rows.schema["row_"].dataType
    longs = T.ArrayType(T.LongType())
    # Pieces travel in groups, so that what belongs to a partition as a whole is joined to groups, not to pieces.
    grouped = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rows", T.ArrayType(row)), T.StructField("lengths", longs), T.StructField("places", longs)])
    groups = stored(rows.mapInArrow(numbered, grouped), "pieces")
    per = stored(groups.select("part", F.explode("lengths").alias("length")).groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = groups.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity, node_limit)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each partition: where its rows of each length begin. At most `capacity` numbers each.
    base = per.select("part", F.struct("length", F.coalesce(before, F.lit(0)).alias("before")).alias("x"))
    base = base.groupBy("part").agg(F.collect_list("x").alias("x")).select("part", F.col("x.length").alias("known"), F.col("x.before").alias("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pieces, length, number, known, earlier = (batch.column(c)[i].values for c in range(5))
                length = length.to_numpy()
                base = np.zeros(capacity + 1, dtype=np.int64)
                base[known.to_numpy()] = earlier.to_numpy()
                number = number.to_numpy() + base[length]
                sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
                order = np.argsort(length, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                    x = int(length[own[0]])
                    first, start, at, slots = places.value[x]
                    entry = np.searchsorted(first, number[own], side="right") - 1
                    k = number[own] - first[entry]
                    sequence[own] = start[entry] + k // slots[entry]
                    offset[own] = at[entry] + k % slots[entry] * x
                yield pa.RecordBatch.from_arrays([pieces, pa.array(sequence), pa.array(offset)], names=["row_", "sequence_id", "offset"])

    schema = T.StructType([T.StructField("row_", row), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = groups.join(base, "part").select("rows", "lengths", "places", "known", "before").mapInArrow(placed, schema)
    return out.select("row_.*", "sequence_id", "offset")
