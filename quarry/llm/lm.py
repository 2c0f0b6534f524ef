"""Language-model scoring: Katz backoff over words, with Good-Turing discounts and exactly normalised backoff weights.

Tokens are the words of a text, A-Z in lower case, parted by ASCII white space, then one end. The model has n-grams up
to `order`, over all words of the training rows; there is no limit on the vocabulary or on the n-grams:

    P_k(w | context) = scale(context) d_k(n) n               for an n-gram seen n times after a context that was seen
                     = alpha(context) P_k-1(w | shorter)     for one that wasn't
                     = P_k-1(w | shorter)                    after a context that wasn't seen
    P_1(w) = scale d_1(n) n;  words never seen share one class, which has what the discounts leave

d_k is Good-Turing's discount up to counts of 5, by order. alpha is what the discounts of a context leave over what P_k-1
gives its unseen successors, so that each distribution sums to 1. Where discounts leave less than 1 / (n + 1) (or the
counts of counts give none), a context's probabilities are scaled to leave that much. Log10 probabilities are held as
whole multiples of 2^-26, so that sums don't depend on their order.

How it runs. Texts are read once and become chunks of about CHUNK tokens: one row each, with the words that occur and
the tokens as numbers of these words. Then, order by order, each chunk asks for what it needs to know, once for each
different n-gram, in compressed blocks by hash of the context: the n-gram, how often it occurs in training rows of the
chunk, and P_k-1. A bucket merges the blocks of all chunks into its part of the n-gram table (stored, a row for each
bucket), and when the counts of counts of the order are known answers each chunk in the order in which it asked. An
n-gram's place in the table is its id as a context of the next order. What goes up and down is at most one entry for
each different n-gram of a chunk: a frequent n-gram is summed up before it travels. A context that is so frequent that
its successors could overfill a bucket (n > HOT) is dealt over all buckets by its successors; its sums, a row for each
such context, are then added up first. Of these there are at most tokens / HOT; nothing of the vocabulary's size
reaches the driver or is broadcast. The blocks of a chunk are as many as there are buckets, or n-grams if fewer.

Edge cases: a null text counts as empty: one token, the end. Without training rows all words are unseen, of probability
1, and n_known is 0. Null doc_ids count as the empty id for the held-out rule. Repeated rows each count and are scored.
A text of more than a chunk's tokens is cut into pieces that know the words before them. Other columns are left out,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket_py, fresh, over_runs, stored, trim_memory

END = b"\n"  # no word holds white space
UNSEEN, ENDED, START, FIRST = 0, 1, 2, 3  # ids: of all words never seen, of the end, of a text's start, of the first word or n-gram
LIMIT = 5
CHUNK = 1 << 21
BUCKET = 1 << 21
HOT = 1 << 23
FINE = float(1 << 26)
TASKS = 100_000  # most partitions of a shuffle


def words(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def held_out(doc_id) -> bool:
    return crc_bucket_py(doc_id, 10) == 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up: bytes of one place together, as many places as needed, compressed."""
    heads, parts = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype="<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        heads += [len(x), width]
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(heads, dtype="<u4").tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, "<u4", 1)[0])
    heads = np.frombuffer(blob, "<u4", 2 * k, 4).astype(np.int64).reshape(k, 2)
    raw = np.frombuffer(pa.decompress(blob[4 + 8 * k :], decompressed_size=int(heads.prod(axis=1).sum()), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for n, width in heads.tolist():
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += n * width
    return out


def pack_few(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, places) for pack: places among the distinct values where these are few, else the values themselves."""
    values, places = np.unique(x, return_inverse=True)
    return (values, places) if 4 * len(values) < len(x) else (x[:0], x)


def unpack_few(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values[places] if len(values) else places


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


# Chunks

CHUNKS = "chunk long, size long, n_words long, cut boolean, words binary, counts binary, tokens binary, pieces binary, ids array<long>"


def chunks(docs: DataFrame, order: int, limit: int) -> DataFrame:
    """A row for each chunk of the docs (doc_id, text).

    words: the different ones, most frequent first (number 1 on; the end is 0); counts: of each in training rows;
    tokens: numbers of words; pieces: uid, length, held, leading tokens that only are context, and whether it begins a
    text; ids: doc_id by piece.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        number, uid = 0, part
        numbers: defaultdict = defaultdict(count().__next__)
        numbers[END]
        parts: list[np.ndarray] = []
        pieces: list[tuple] = []
        ids: list = []
        size = 0

        def flush():
            nonlocal numbers, number, size
            token = np.concatenate(parts)
            length, held, skip = (np.array([p[i] for p in pieces]) for i in (1, 2, 3))
            begin = np.cumsum(length) - length
            counted = np.repeat(held == 0, length)
            for at, k in zip(begin[skip > 0].tolist(), skip[skip > 0].tolist(), strict=True):
                counted[at : at + k] = False
            own = np.bincount(token, minlength=len(numbers))
            by = np.r_[0, 1 + np.argsort(-own[1:], kind="stable")]
            place = np.empty(len(by), dtype=np.int64)
            place[by] = np.arange(len(by))
            names = list(numbers)
            trained = np.bincount(token[counted], minlength=len(numbers))[by]
            row = [
                part | number, len(token), len(names), any(p[3] or not p[4] for p in pieces),
                pa.compress(b"\n".join([names[i] for i in by[1:].tolist()]), codec="zstd", asbytes=True) if len(names) > 1 else b"",
                pack(trained, np.array([sum(len(x) + 1 for x in names[1:])])), pack(place[token]), pack(*np.array(pieces).T), list(ids),
            ]
            number, size = number + 1, 0
            numbers = defaultdict(count().__next__)
            numbers[END]
            for held_list in (parts, pieces, ids):
                held_list.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own = words(text)
                    at = 0
                    while at < len(own):
                        skip = min(at, order - 1)
                        upto = min(len(own), at + max(order, limit - size))
                        got = own[at - skip : upto]
                        parts.append(np.fromiter(map(numbers.__getitem__, got), np.int64, len(got)))
                        pieces.append((uid, len(got), int(held_out(doc_id)), skip, int(at == 0)))
                        ids.append(doc_id)
                        size += len(got)
                        at = upto
                        if size >= limit:
                            yield flush()
                    uid += 1
        if parts:
            yield flush()
        trim_memory()

    return docs.mapInArrow(each, CHUNKS)


def chunk_words(blob: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    trained, size = unpack(counts)
    text = pa.decompress(blob, decompressed_size=int(size[0]) - 1, codec="zstd", asbytes=True) if blob else b""
    return (text.split(b"\n") if blob else []), trained


# Counts and weights


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0..LIMIT) from the numbers of n-grams seen 1 to LIMIT + 1 times; all 1 beyond. Falls back on (r - 0.5) / r where Good-Turing has no answer."""
    out = np.ones(LIMIT + 1)
    n = counts.astype(float)
    common = (LIMIT + 1) * n[LIMIT + 1] / n[1] if n[1] else np.inf
    for r in range(1, LIMIT + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and n[1] and common != 1 else -1.0
        out[r] = good if 0 < good < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.where(counts <= LIMIT, discount[np.minimum(counts, LIMIT)], 1.0) * counts


def tally(counts: np.ndarray) -> list[int]:
    """How many are 0 to LIMIT + 1."""
    return np.bincount(np.minimum(counts, LIMIT + 2), minlength=LIMIT + 3)[: LIMIT + 2].tolist()


def weights(n: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of a seen n-gram's discounted count, alpha) of contexts seen n times, from the sums over their successors of discounted counts and P_k-1."""
    unseen = np.maximum(1 - seen, 1e-15)  # there always is a word never seen
    left = np.maximum(1 - kept / n, 1 / (n + 1))
    return (1 - left) / kept, left / unseen


@dataclass
class Unigrams:
    """What a chunk needs to score words by their counts."""

    total: int
    distinct: int
    ends: int
    discount: np.ndarray
    scale: float
    left: float  # probability of the class of words never seen

    @classmethod
    def of(cls, total: int, ends: int, seen: np.ndarray, distinct: int) -> Unigrams:
        d = discounts(seen)
        if not total:
            return cls(0, 0, 0, d, 0.0, 1.0)
        kept = total - sum(int(seen[r]) * r * (1 - d[r]) for r in range(1, LIMIT + 1))
        left = max(1 - kept / total, 1 / (total + 1))
        return cls(total, distinct, ends, d, (1 - left) / kept, left)

    def fine(self, counts: np.ndarray) -> np.ndarray:
        """-log10 P_1 in units of 1 / FINE."""
        p = np.where(counts > 0, self.scale * discounted(counts, self.discount), self.left)
        return np.rint(-np.log10(p) * FINE).astype(np.int64)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


# A chunk's view of the n-grams


class View:
    """A chunk's tokens and the n-grams among them, with what the buckets answered up to some order."""

    def __init__(self, row: dict, replies: dict[int, list[dict]], unigrams: Unigrams, hot: dict[int, np.ndarray], buckets: dict[int, int]) -> None:
        (self.token,) = unpack(row["tokens"])
        self.uid, self.length, self.held, self.skip, self.begins = unpack(row["pieces"])
        n = len(self.token)
        self.piece = np.repeat(np.arange(len(self.length)), self.length)
        start = np.cumsum(self.length) - self.length
        self.place = np.arange(n) - start[self.piece]  # in the piece
        self.counted = (self.held[self.piece] == 0) & (self.place >= self.skip[self.piece])
        self.word_id = np.zeros(row["n_words"], dtype=np.int64)
        self.count = np.zeros(row["n_words"], dtype=np.int64)
        self.word_id[0], self.count[0] = ENDED, unigrams.ends
        names, _ = chunk_words(row["words"], row["counts"])
        own = word_buckets(names, buckets[1])
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(buckets[1] + 1))
        for r in replies.get(1, []):
            at = 1 + order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]]
            rank, self.count[at] = unpack(r["data"])
            self.word_id[at] = np.where(self.count[at] > 0, rank * buckets[1] + r["bucket"] + FIRST, UNSEEN)
        self.value = unigrams.fine(self.count)[self.token]  # -log10 of the last order that is known, by token
        # Contexts of the next order: the symbol before each token, and the symbols' ids (0: never seen).
        self.hot, self.buckets = hot, buckets
        before = np.r_[0, self.token[:-1]] if n else self.token
        self.symbol = np.where(self.place > 0, before, np.where(self.begins[self.piece] == 1, len(self.word_id), -1))
        self.symbol_id = np.r_[self.word_id, START if unigrams.ends else UNSEEN]
        for k in range(2, max(replies, default=1) + 1):
            self.ask(k)
            self.learn(k, replies[k])

    def ask(self, k: int) -> None:
        """Find the different n-grams of order k: context, word, times in training rows, -log10 P_k-1, in order of bucket, context and word."""
        known = np.flatnonzero(np.where(self.symbol >= 0, self.symbol_id[self.symbol], UNSEEN) != UNSEEN)
        contexts, context = np.unique(self.symbol_id, return_inverse=True)
        names, name = np.unique(self.word_id, return_inverse=True)
        if len(contexts) >= 1 << 31 or len(names) >= 1 << 31:
            raise ValueError("too many words in a chunk")
        key = context[self.symbol[known]].astype(np.uint64) << np.uint64(32) | name[self.token[known]].astype(np.uint64) << np.uint64(1) | ~self.counted[known]
        order = np.argsort(key)
        key = key[order]
        first = edges(key >> np.uint64(1))
        event = np.empty(len(key), dtype=np.int64)
        event[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        self.context = contexts[(key[first] >> np.uint64(32)).astype(np.int64)]
        self.name = names[(key[first] >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)]
        self.times = np.add.reduceat(1 - (key & np.uint64(1)).astype(np.int64), first) if len(first) else first
        self.lower = self.value[known[order[first]]]
        bucket = bucket_of(self.context, self.name, self.hot[k], self.buckets[k])
        by = np.argsort(bucket.astype(np.uint32), kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        self.bucket = bucket[by]
        for column in ("context", "name", "times", "lower"):
            setattr(self, column, getattr(self, column)[by])
        self.event = np.full(len(self.token), -1, dtype=np.int64)
        self.event[known] = place[event]

    def learn(self, k: int, replies: list[dict]) -> None:
        """Take the answers: values of order k, and the n-grams as symbols of the next order."""
        value, ids = np.zeros(len(self.bucket), dtype=np.int64), np.zeros(len(self.bucket), dtype=np.int64)
        for r in replies:
            begin, end = np.searchsorted(self.bucket, [r["bucket"], r["bucket"] + 1])
            values, places, *known = unpack(r["data"])
            value[begin:end] = unpack_few(values, places)
            if known:
                step, seen = known[0] >> 1, known[0] & 1
                ids[begin:end] = np.where(seen, np.cumsum(step) * self.buckets[k] + r["bucket"] + FIRST, UNSEEN)
        own = self.event >= 0
        self.value[own] = value[self.event[own]]
        self.symbol = np.where(self.place > 0, np.r_[-1, self.event[:-1]], -1)
        self.symbol_id = np.r_[ids, UNSEEN]  # one at least, for tables without any


def word_buckets(names: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets


def bucket_of(context: np.ndarray, name: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    out = mixed(context)
    if len(hot):
        spread = np.isin(context, hot)
        out[spread] = mixed(out[spread] + name[spread].astype(np.uint64))
    return ((out >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


# Asking and answering

BLOCKS = "bucket int, chunk long, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "data"])


def ask_words(found: DataFrame, buckets: int) -> DataFrame:
    """BLOCKS: a chunk's words of each bucket, with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, trained = chunk_words(blob, counts)
                own = word_buckets(names, buckets)
                order = np.argsort(own, kind="stable")
                bounds = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
                rows = []
                for b in np.unique(own).tolist():
                    at = order[bounds[b] : bounds[b + 1]]
                    text = b"\n".join([names[i] for i in at.tolist()])
                    data = pack(trained[1 + at])
                    rows.append((b, chunk, np.array([len(text), len(data)], dtype="<u4").tobytes() + data + pa.compress(text, codec="zstd", asbytes=True)))
                yield _batch(rows)

    return found.select("chunk", "words", "counts").mapInArrow(each, BLOCKS)


TABLE = "bucket int, chunk long, data binary, seen array<long>, hot array<long>"


def count_words(table: pa.Table) -> pa.Table:
    """A bucket's words: a row with the table (no chunk), and one for each chunk with the words' ranks and counts."""
    order = np.argsort(table["chunk"].to_numpy(), kind="stable")
    owners = table["chunk"].to_numpy()[order].tolist()
    bucket = table["bucket"][0].as_py()
    texts, counts = [], []
    data = table["data"].to_pylist()
    for i in order.tolist():
        size, packed = np.frombuffer(data[i], "<u4", 2).tolist()
        counts.append(unpack(data[i][8 : 8 + packed])[0])
        texts.append(pa.array(pa.decompress(data[i][8 + packed :], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n"), pa.binary()))
    coded = pa.chunked_array(texts).dictionary_encode().combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
    place = coded.indices.to_numpy().astype(np.int64)
    sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    by = np.argsort(-sums, kind="stable")
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    seen = by[: int((sums > 0).sum())]
    text = b"\n".join(coded.dictionary.take(pa.array(seen)).to_pylist())
    rows = [(bucket, None, np.uint32(len(text)).tobytes() + pa.compress(text, codec="zstd", asbytes=True), tally(sums[sums > 0]) + [len(seen)])]
    hot = (np.flatnonzero(sums[by] > HOT) * table["buckets"][0].as_py() + bucket + FIRST).tolist()
    at = 0
    for owner, own in zip(owners, counts, strict=True):
        mine = place[at : at + len(own)]
        at += len(own)
        rows.append((bucket, owner, pack(np.where(sums[mine] > 0, rank[mine], 0), sums[mine]), None))
    columns = list(zip(*rows, strict=True))
    return pa.table(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64())), pa.array([hot] + [None] * (len(rows) - 1), pa.list_(pa.int64()))],
        names=["bucket", "chunk", "data", "seen", "hot"],
    )


class Chunks:
    """The chunks of a corpus and the answers they have had so far."""

    def __init__(self, found: DataFrame) -> None:
        self.found, self.replies = found, []  # by order, from 1

    def over(self, work, schema: str, n: int) -> DataFrame:
        """work(chunk's row, its replies by order) on each chunk."""
        own = ["chunk", "n_words", "words", "counts", "tokens", "pieces", "ids"]
        both = self.found.select(*own, F.lit(0).alias("order"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"))
        types = dict(both.dtypes)
        for k, replies in enumerate(self.replies, 1):
            none = [F.lit(None).cast(types[c]).alias(c) for c in own[1:]]
            both = both.unionByName(replies.select("chunk", *none, F.lit(k).alias("order"), "bucket", "data"))
        orders = len(self.replies)

        def each(table: pa.Table) -> pa.Table | None:
            row, replies = None, {k: [] for k in range(1, orders + 1)}
            for r in table.to_pylist():
                if r["order"]:
                    replies[r["order"]].append(r)
                else:
                    row = r
            return work(row, replies)

        return over_runs(both, "chunk", each, schema, min(n, TASKS))


def ask(corpus: Chunks, k: int, model, n_chunks: int) -> DataFrame:
    """BLOCKS: a chunk's n-grams of order k for each bucket."""

    def work(row: dict, replies: dict) -> pa.Table | None:
        view = View(row, replies, *model.value)
        view.ask(k)
        bounds = [*edges(view.bucket).tolist(), len(view.bucket)]
        rows = []
        for i, j in zip(bounds, bounds[1:], strict=False):
            context = view.context[i:j]
            runs = edges(context)
            own = pack(np.diff(context[runs], prepend=0), np.diff(np.r_[runs, j - i]), view.name[i:j], view.times[i:j], *pack_few(view.lower[i:j]))
            rows.append((int(view.bucket[i]), row["chunk"], own))
        return pa.Table.from_batches([_batch(rows)]) if rows else None

    return corpus.over(work, BLOCKS, n_chunks)


GRAMS = "bucket int, grams binary, chunks array<long>, places array<binary>, seen array<long>, hot array<long>"


def merge(table: pa.Table) -> pa.Table:
    """A bucket's part of the n-gram table, in order of context and word, and where in it the n-grams of each chunk are."""
    blocks = [unpack(b) for b in table["data"].to_pylist()]
    sizes = [len(b[2]) for b in blocks]
    runs = [np.cumsum(b[0]) for b in blocks]
    contexts, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    context = np.repeat(inverse, np.concatenate([b[1] for b in blocks]))
    names, name = np.unique(np.concatenate([b[2] for b in blocks]), return_inverse=True)
    key = context.astype(np.uint64) << np.uint64(32) | name.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = edges(key)
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    times = np.add.reduceat(np.concatenate([b[3] for b in blocks])[order], first)
    lower = np.concatenate([unpack_few(b[4], b[5]) for b in blocks])[order[first]]
    at = (key[first] >> np.uint64(32)).astype(np.int64)
    runs = edges(at)
    grams = pack(np.diff(contexts[at[runs]], prepend=0), np.diff(np.r_[runs, len(at)]), names[(key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)], times, *pack_few(lower))
    bounds = np.cumsum([0, *sizes])
    places = [pack(np.diff(place[a:b], prepend=0)) for a, b in zip(bounds, bounds[1:], strict=False)]
    bucket, buckets = table["bucket"][0].as_py(), table["buckets"][0].as_py()
    hot = (np.flatnonzero(times > HOT) * buckets + bucket + FIRST).tolist()
    columns = [[bucket], [grams], [table["chunk"].to_pylist()], [places], [tally(times[times > 0])], [hot]]
    types = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in GRAMS.split(", ")])


def grams_of(blob: bytes) -> tuple[np.ndarray, ...]:
    """(contexts, first row of each, words, counts, -log10 P_k-1) of a bucket's n-grams."""
    steps, runs, name, times, values, places = unpack(blob)
    return np.cumsum(steps), np.cumsum(runs) - runs, name, times, unpack_few(values, places)


def sums_of(first: np.ndarray, times: np.ndarray, lower: np.ndarray, discount: np.ndarray) -> list[np.ndarray]:
    """Of each context: times seen, discounted counts, and P_k-1 of its seen successors."""
    p = np.where(times > 0, 10.0 ** (-lower / FINE), 0.0)
    return [np.add.reduceat(x, first) for x in (times.astype(float), discounted(times, discount), p)]


def hot_sums(grams: DataFrame, hot: np.ndarray, discount: np.ndarray) -> dict[int, tuple[float, float, float]]:
    """The sums of contexts that are dealt over buckets."""
    if not len(hot):
        return {}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                contexts, first, _, times, lower = grams_of(blob)
                own = np.flatnonzero(np.isin(contexts, hot))
                sums = sums_of(first, times, lower, discount)
                yield pa.RecordBatch.from_arrays([pa.array(contexts[own]), *(pa.array(s[own]) for s in sums)], names=["context", "n", "kept", "seen"])

    parts = grams.select("grams").mapInArrow(each, "context long, n double, kept double, seen double")
    rows = parts.groupBy("context").agg(F.sum("n"), F.sum("kept"), F.sum("seen")).collect()  # at most tokens / HOT
    return {r[0]: tuple(r[1:]) for r in rows}


def answer(grams: DataFrame, shared, last: bool) -> DataFrame:
    """BLOCKS: the values of order k that each chunk asked for and, if not the last order, the n-grams' ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        discount, spread = shared.value
        for batch in batches:
            for bucket, blob, owners, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                contexts, first, _, times, lower = grams_of(blob)
                sums = np.array(sums_of(first, times, lower, discount))
                for i in np.flatnonzero(np.isin(contexts, list(spread))).tolist() if spread else ():
                    sums[:, i] = spread[int(contexts[i])]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scale, alpha = weights(*sums)
                    own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(times)]))
                    value = np.where(times > 0, -np.log10(discounted(times, discount) * scale[own]), lower / FINE - np.log10(alpha[own]))
                value = np.rint(np.maximum(value, 0) * FINE).astype(np.int64)
                for owner, steps in zip(owners, places, strict=True):
                    (step,) = unpack(steps)
                    at = np.cumsum(step)
                    known = () if last else (step << 1 | (times[at] > 0),)
                    yield _batch([(bucket, owner, pack(*pack_few(value[at]), *known))])
        trim_memory()

    return grams.select("bucket", "grams", "chunks", "places").mapInArrow(each, BLOCKS)


ROWS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, fine long"


def sums(corpus: Chunks, model, n_chunks: int) -> DataFrame:
    """ROWS: the sums over each piece's tokens."""

    def work(row: dict, replies: dict) -> pa.Table:
        view = View(row, replies, *model.value)
        own = view.place >= view.skip[view.piece]
        piece, n = view.piece[own], len(view.length)
        total = lambda x: np.bincount(piece, weights=x[own], minlength=n)  # noqa: E731 - exact for whole numbers below 2^53
        base = model.value[0].base(view.count)[view.token]
        columns = [view.uid, row["ids"], view.held == 1, total(np.ones(len(own))).astype(np.int64), total((view.count > 0)[view.token].astype(float)).astype(np.int64), total(base), total(view.value.astype(float)).astype(np.int64)]
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    return corpus.over(work, ROWS, n_chunks)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; learns from those not held out."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = fresh(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = stored(chunks(rows, order, CHUNK), "chunks")
    whole = found.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("n_words").alias("words"), F.max("cut").alias("cut")).first()
    n_chunks = max(1, whole.n)
    buckets = {1: max(1, -(-(whole.words or 0) // BUCKET))} | dict.fromkeys(range(2, order + 1), max(1, -(-(whole.size or 0) // BUCKET)))
    corpus = Chunks(found)

    # Order 1: words.
    asked = ask_words(found, buckets[1]).withColumn("buckets", F.lit(buckets[1]))
    unigrams = stored(over_runs(asked, "bucket", count_words, TABLE, min(buckets[1], TASKS)), "unigrams")
    parts = unigrams.where("chunk is null")
    corpus.replies.append(unigrams.where("chunk is not null").select("bucket", "chunk", "data"))
    ends, total = _trained(found)
    seen = np.array(_added(parts) or [0] * (LIMIT + 3))
    if ends:
        seen[min(ends, LIMIT + 2)] += ends <= LIMIT + 1
        seen[-1] += 1
    model = Unigrams.of(total, ends, seen[: LIMIT + 2], int(seen[-1]))
    hot = {2: np.array(sorted(_hot(parts) + [START, ENDED] * (ends > HOT)), dtype=np.int64)}

    for k in range(2, order + 1):
        state = share((model, dict(hot), buckets))
        asked = ask(corpus, k, state, n_chunks).withColumn("buckets", F.lit(buckets[k]))
        grams = stored(over_runs(asked, "bucket", merge, GRAMS, min(buckets[k], TASKS)), "grams")
        discount = discounts(np.array(_added(grams) or [0] * (LIMIT + 2)))
        spread = hot_sums(grams, hot[k], discount)
        hot[k + 1] = np.array(sorted(_hot(grams)), dtype=np.int64)
        corpus.replies.append(stored(answer(grams, share((discount, spread)), k == order), "replies"))

    out = sums(corpus, share((model, hot, buckets)), n_chunks)
    if whole.cut:
        out = out.groupBy("uid").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "fine")])
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("fine") / -FINE).alias("score")
    )


def _added(parts: DataFrame) -> list[int]:
    return [r.n for r in parts.select(F.posexplode("seen").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()]


def _hot(parts: DataFrame) -> list[int]:
    """Ids of what was seen more than HOT times: at most tokens / HOT."""
    return [r.id for r in parts.select(F.explode("hot").alias("id")).collect()]


def _trained(found: DataFrame) -> tuple[int, int]:
    """(texts, tokens) of the training rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [unpack(x)[0] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in sums], pa.int64()), pa.array([int(x.sum()) for x in sums], pa.int64())], names=["ends", "total"])

    r = found.select("counts").mapInArrow(each, "ends long, total long").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total")).first()
    return r.ends or 0, r.total or 0
