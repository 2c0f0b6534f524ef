import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_plan_uses_every_piece_and_is_tight():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(rng.randint(1, 30))}
        used = defaultdict(int)
        plan = packing.plan(counts, 100)
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= 100
            for x in pattern:
                used[x] += times
        assert used == counts
        least = -(-sum(x * n for x, n in counts.items()) // 100)
        assert sum(t for _, t in plan) >= max(least, sum(n for x, n in counts.items() if x > 50))
    # Where best fit decreasing needs three, completion needs two.
    assert sum(t for _, t in packing.plan({6: 1, 5: 1, 3: 2, 2: 1, 1: 1}, 10)) == 2


def _valid(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, sf):
    from quarry.llm import queries

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op7_packing(spark, sf).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    total = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == [a for a, _ in packing.cut(len(ids), 2048)]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    n = _valid(got, 2048)
    assert n <= 1.02 * -(-total // 2048) + 1


def test_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 9000), (3, "a b c")] + [(10, "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as sequence_id")
    found = packing.pieces(df, P.path("byte_bpe_50k.json"), P.PATTERN)
    got = packing.pack(found).collect()
    assert len([r for r in got if r.piece == 0]) == len(rows)
    _valid(got, 2048)
    assert packing.pack(packing.pieces(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_short_documents_do_not_recurse():
    for counts in ({2: 5000, 3: 1}, {1: 3, 2: 4000, 7: 900}, {2: 1023, 2045: 1, 3: 1, 5: 2}):
        used = defaultdict(int)
        for pattern, times in packing.plan(counts, 2048):
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] += times
        assert used == counts


@pytest.mark.parametrize("limit", [1, 3, 10**6])
def test_fillings_are_least_with_any_limit(limit):
    rng, limited = random.Random(4), 0
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 7))}
        room = rng.randint(1, 60)
        search = packing.Completion(counts, limit)
        have = search.fill(room)
        reach = {0}
        for x, n in counts.items():
            reach = {a + k * x for a in reach for k in range(n + 1)}
        assert sum(have) == max(a for a in reach if a <= room)
        limited += search.limited
        assert all(have.count(x) <= counts[x] for x in have)
    assert (limited > 0) == (limit < 10**6)


def test_one_word_documents_and_clashing_columns(spark):
    rows = [(i, "word" if i % 3 else "the word") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pieces(df, P.path("byte_bpe_50k.json"), P.PATTERN)
    more = found.selectExpr("*", "'a' as part_", "'b' as place_", "1 as before_", "2 as part", "3 as rows", "4 as sequence_id", "5 as row_")
    got = packing.pack(more).collect()
    assert len(got) == len(rows) and _valid(got, 2048) == -(-sum(r.length for r in got) // 2048)
    assert {(r.part_, r.place_, r.before_, r.part, r.rows, r.row_) for r in got} == {("a", "b", 1, 2, 3, 5)}
