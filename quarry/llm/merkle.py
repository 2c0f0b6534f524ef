"""A Merkle manifest of a dataset: a tree over each group's rows, and one over the groups, with a proof for each row.

H is sha256, as lower-case hex, of its inputs one after the other. A leaf is H of a row's columns, each written as its
length in UTF-8 bytes, a colon and its value, or - for null. In each tree runs of three neighbours (the last run may
be shorter) become their H until one node remains. Groups are ordered with null first, then by UTF-8 bytes; rows in a
group by id with null first, then by leaf.

Leaves are made where the texts are read; from there on a row is its key and digests. They are dealt by ranges of
(group, id, leaf, row number) to an RDD whose partitions are sorted, so that a hot group, or any number of equal rows,
spans as many partitions as it needs. Each partition reports its first and last group's counts, and only these, two
rows a partition, go through the driver, to give each partition the place of its first leaf and the sizes of its outer groups.
Then each partition builds, alone, all runs that lie whole within it, level by level. What is left are ragged nodes at its
edges, a few for each level. They are shuffled by coordinate: bands of BAND levels are finished in turn, a task
holding only the nodes below one node of the band's upper end, at most 1.5 * 3^BAND. Group roots are the leaves of the
upper tree, built in the same way. Proofs come back down the bands, the siblings from the root to each ragged node, and
meet the leaves' partition there by the partitioner that dealt them, so that leaves are shuffled only once.

Edge cases: each row is a leaf, also where ids or whole rows repeat. A null id or group is a value of its own, before all
others. A tree of one leaf is that leaf, without siblings; a proof without any is H of nothing. Texts are taken whole.
Other columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

ARITY = 3
#: Levels that one shuffle of ragged nodes finishes.
BAND = 6
#: Leaves of a partition, about.
ROWS = 100_000
#: Keys that are sampled for ranges: so many a partition, and in all, at most.
SAMPLED, SAMPLED_IN_ALL = 20, 1_000_000


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def joined(digests) -> bytes:
    return "".join([d.hex() for d in digests]).encode()


def parent(digests) -> bytes:
    return sha256(joined(digests)).digest()


def depth(total: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def width(total: int, level: int) -> int:
    """Nodes of a level."""
    return max(1, -(-total // ARITY**level))


def climb(nodes: list[bytes], start: int, total: int) -> tuple[list[tuple[int, list[bytes]]], list[tuple[int, int, bytes]]]:
    """What can be built from neighbouring leaves alone, of a tree of `total`: levels (start, nodes), and ragged nodes (level, index, digest)."""
    levels, ragged, level = [(start, nodes)], [], 0
    while total > 1:
        end = start + len(nodes)
        first, last = -(-start // ARITY), -(-total // ARITY) if end == total else end // ARITY
        whole = range(first, max(first, last))
        ragged += [(level, start + i, d) for i, d in enumerate(nodes) if (start + i) // ARITY not in whole]
        if not whole:
            return levels, ragged
        nodes = [parent(nodes[max(0, ARITY * r - start) : ARITY * (r + 1) - start]) for r in whole]
        start, total, level = first, -(-total // ARITY), level + 1
        levels.append((start, nodes))
    return levels, [*ragged, (level, 0, nodes[0])]


def beside(known: dict[tuple[int, int], bytes], total: int, level: int, index: int) -> tuple[int, tuple[bytes, ...]]:
    """A node's place in its run, and its siblings."""
    first = index - index % ARITY
    return index - first, tuple(known[level, i] for i in range(first, min(first + ARITY, width(total, level))) if i != index)


def _spread(key) -> int:
    return zlib.crc32(repr(key).encode())


class Forest:
    """A tree over each group of an RDD of ((group, order), (digest, payload)), whose keys are unique."""

    def __init__(self, entries: RDD, count: int, rows: int, band: int) -> None:
        cores = entries.context.defaultParallelism
        self.parts = parts = max(1, -(-count // rows), min(2 * cores, -(-count // 2000)))
        share = min(1.0, min(SAMPLED * parts, SAMPLED_IN_ALL) / max(1, count))
        sample = sorted(entries.keys().sample(False, share, 1).collect()) if parts > 1 else []
        bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
        self.place = lambda key: bisect_right(bounds, key)
        self.ranges, self.band = entries.partitionBy(parts, self.place), band
        self.known, most = _offsets(self.ranges.mapPartitionsWithIndex(_ends).collect())
        self.ragged = self.ranges.mapPartitionsWithIndex(self._boundary()).persist(StorageLevel.MEMORY_AND_DISK)
        self.nodes: list[RDD] = []
        self._finish(depth(most) // band + 1)

    def _segments(self) -> Callable:
        """Of a partition's entries, each group with its sorted rows, the place of the first and the group's size."""
        known = self.known

        def of(index: int, rows: list) -> Iterator[tuple]:
            rows.sort(key=lambda r: r[0])
            groups = [(g, list(x)) for g, x in groupby(rows, key=lambda r: r[0][0])]
            for i, (group, own) in enumerate(groups):
                offset, first, last = known[index]
                yield group, own, offset if i == 0 else 0, first if i == 0 else last if i == len(groups) - 1 else len(own)

        return of

    def _boundary(self) -> Callable:
        segments, band = self._segments(), self.band

        def of(index: int, rows: Iterator) -> Iterator[tuple]:
            for group, own, start, total in segments(index, list(rows)):
                for level, i, digest in climb([r[1][0] for r in own], start, total)[1]:
                    # By what band it is for; own[0]'s key leads back to this partition.
                    yield level // band, _node(group, total, level, i, digest, own[0][0], band)

        return of

    def _finish(self, bands: int) -> None:
        """The levels above the ragged nodes, band by band; roots: (group, (total, digest))."""
        band, above, roots = self.band, None, None
        for k in range(bands):
            own = self.ragged.filter(lambda x, k=k: x[0] == k).values()
            own = own if above is None else own.union(above)
            self.nodes.append(own)
            raised = own.groupByKey(self.parts, _spread).flatMap(lambda x, k=k: _raised(x[0], x[1], k, band))
            above = raised.filter(lambda x: x[0]).values()
            tops = raised.filter(lambda x: not x[0]).values()
            roots = tops if roots is None else roots.union(tops)
        self.roots = roots

    def walk(self, heads: RDD) -> RDD:
        """(key, digest, payload, carried, runs) of each entry: runs are (place, siblings) from the leaf up. heads: (group, (total, carried, runs above the root))."""
        band, found, down = self.band, None, None
        for k in reversed(range(len(self.nodes))):
            above = heads.filter(lambda x, k=k: depth(x[1][0]) // band == k).map(lambda x: ((x[0], 0), x[1][1:]))
            above = above if down is None else above.union(down)
            below = self.nodes[k].cogroup(above, self.parts).flatMap(lambda x, k=k: _lowered(x[0], *x[1], k, band))
            down = below.filter(lambda x: x[0] is None).values()
            own = below.filter(lambda x: x[0] is not None)
            found = own if found is None else found.union(own)
        return self.ranges.union(found.partitionBy(self.parts, self.place)).mapPartitionsWithIndex(self._proven())

    def _proven(self) -> Callable:
        segments = self._segments()

        def of(index: int, rows: Iterator) -> Iterator[tuple]:
            entries, paths = [], {}
            for row in rows:
                if len(row[1]) == 2:
                    entries.append(row)
                else:
                    (group, level, i), carried, runs = row[1]
                    paths[group, level, i] = carried, runs
            for group, own, start, total in segments(index, entries):
                levels, _ = climb([r[1][0] for r in own], start, total)
                known = {(n, s + i): d for n, (s, nodes) in enumerate(levels) for i, d in enumerate(nodes)}
                above: dict[tuple[int, int], tuple] = {}
                for level in reversed(range(1, len(levels))):
                    for i in range(levels[level][0], levels[level][0] + len(levels[level][1])):
                        above[level, i] = _path(above, paths, known, group, total, level, i)
                for i, (key, (digest, payload)) in enumerate(own, start):
                    carried, link = _path(above, paths, known, group, total, 0, i)
                    yield key, digest, payload, carried, _unlinked(link)

        return of


def _path(above, paths, known, group, total, level, i) -> tuple:
    """(carried, linked runs) of a node: from its parent, if that was built here, or what came down to it."""
    if (level + 1, i // ARITY) in above:
        carried, link = above[level + 1, i // ARITY]
        return carried, (beside(known, total, level, i), link)
    carried, runs = paths[group, level, i]
    link = None
    for run in reversed(runs):
        link = (run, link)
    return carried, link


def _unlinked(link) -> list:
    out = []
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out


def _node(group, total, level, index, digest, owner, band):
    """((group, place of its ancestor at the band's upper end), node)."""
    return (group, index // ARITY ** (band - level % band)), (total, level, index, digest, owner)


def _ends(index: int, rows: Iterator) -> Iterator[tuple]:
    counts: dict = {}
    for key, _ in rows:
        counts[key[0]] = counts.get(key[0], 0) + 1
    if counts:
        first, last = min(counts), max(counts)
        yield index, first, counts[first], last, counts[last], max(counts.values())


def _offsets(ends: list[tuple]) -> tuple[dict[int, tuple[int, int, int]], int]:
    """For each partition the place of its first entry in its group, and the sizes of its first and last group; the largest size."""
    totals, offsets, most = {}, {}, 1
    for index, first, n_first, last, n_last, largest in sorted(ends):
        offsets[index] = totals.get(first, 0)
        for group, n in {first: n_first, last: n_last}.items():
            totals[group] = totals.get(group, 0) + n
        most = max(most, largest)
    return {i: (offsets[i], totals[first], totals[last]) for i, first, _, last, _, _ in ends}, max([most, *totals.values()])


def _built(nodes, k: int, band: int) -> tuple[dict[tuple[int, int], bytes], int]:
    """All nodes of a band below one ancestor, from those that came; and the size of their tree."""
    nodes = list(nodes)
    total = nodes[0][0]
    known = {(level, i): digest for _, level, i, digest, _ in nodes}
    for level in range(k * band, min((k + 1) * band, depth(total))):
        for run in {i // ARITY for n, i in list(known) if n == level}:
            if (level + 1, run) not in known:
                known[level + 1, run] = parent([known[level, i] for i in range(ARITY * run, min(ARITY * (run + 1), width(total, level)))])
    return known, total


def _raised(key, nodes, k: int, band: int) -> Iterator[tuple]:
    """(True, node for the next band) or (False, (group, (total, root)))."""
    known, total = _built(nodes, k, band)
    group, place = key
    top = depth(total)
    if top // band == k:
        yield False, (group, (total, known[top, 0]))
    else:
        level = (k + 1) * band
        yield True, _node(group, total, level, place, known[level, place], None, band)


def _lowered(key, nodes, above, k: int, band: int) -> Iterator[tuple]:
    """The runs above each node that came to a band: (owner, (coordinate, carried, runs)), or (None, (key in the band below, (carried, runs)))."""
    nodes = list(nodes)
    if not nodes:
        return
    known, total = _built(nodes, k, band)
    ((carried, runs),) = above
    end = min((k + 1) * band, depth(total))
    for _, level, index, _, owner in nodes:
        own, i = [], index
        for n in range(level, end):
            own.append(beside(known, total, n, i))
            i //= ARITY
        if owner is None:
            yield None, ((key[0], index), (carried, own + list(runs)))
        else:
            yield owner, ((key[0], level, index), carried, own + list(runs))


def folded(digest: bytes, runs: list) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, siblings in runs:
        digest = parent([*siblings[:place], digest, *siblings[place:]])
    return digest


def _ordered(value):
    """A value as a key: null first, text by its UTF-8 bytes."""
    return (0,) if value is None else (1, value.encode() if isinstance(value, str) else value)


def _result(row) -> tuple:
    (_, (_, _, _)), digest, (ident, other), (subroot, root), runs = row
    proof = sha256()
    for _, siblings in runs:
        proof.update(joined(siblings))
    again = folded(digest if other is None else other, runs)
    return ident, digest.hex(), subroot.hex(), root.hex(), proof.hexdigest(), again.hex(), again == root


def manifest(df: DataFrame, group: str, ident: str, columns: list[str], other: Callable[[DataFrame], Column] | None = None, rows: int = ROWS, band: int = BAND) -> DataFrame:
    """(ident, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    other: a leaf to verify in place of the row's own, null for its own: a column of df's columns group, ident and columns.
    """
    spark, kind = df.sparkSession, df.schema[ident].dataType.simpleString()
    used = fresh(df, *dict.fromkeys([group, ident, *columns]))
    second = F.lit(None).cast("string") if other is None else other(used)
    leaves = used.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{ident}`").alias("ident"), F.unhex(leaf(*[F.col(f"`{c}`") for c in columns])).alias("leaf"), F.unhex(second).alias("other"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    entries = leaves.rdd.map(lambda r: ((_ordered(r.group), (_ordered(r.ident), bytes(r.leaf), r.row)), (bytes(r.leaf), (r.ident, None if r.other is None else bytes(r.other)))))
    lower = Forest(entries, leaves.count(), rows, band)
    groups = lower.roots.map(lambda x: ((0, x[0]), (x[1][1], x[1][0]))).persist(StorageLevel.MEMORY_AND_DISK)
    upper = Forest(groups, groups.count(), rows, band)
    # The upper tree's head carries the root, and its entries' paths are the heads of the lower trees.
    tops = upper.walk(upper.roots.map(lambda x: (x[0], (x[1][0], x[1][1], []))))
    heads = tops.map(lambda x: (x[0][1], (x[2], (x[1], x[3]), x[4])))
    schema = f"`{ident}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = spark.createDataFrame(lower.walk(heads).map(_result), schema, verifySchema=False)
    out = stored(found, "manifest")
    for kept in (lower.ragged, upper.ragged, groups):
        kept.unpersist()
    return out
