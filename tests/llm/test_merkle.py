import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(leaves):
    """The root, and each leaf's runs: (place, siblings)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            p.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: tuples of COLUMNS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((own, *_tree([_leaf(r) for r in own])))
    root, tops = _tree([t[1] for t in trees]) if trees else ("", [])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            path, node = path + top, _leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = _leaf((*r[:4], r[4].replace("\n", "")))
            for i, s in path:
                node = H(*s[:i], node, *s[i:])
            out.append((r[0], _leaf(r), subroot, root, H(*[x for _, s in path for x in s]), node, node == root))
    return sorted(out, key=str)


def _rows(sizes, seed=1):
    rng = random.Random(seed)
    out, n = [], 0
    for source, size in sizes:
        for _ in range(size):
            n += rng.randrange(1, 4)
            text = rng.choice([None, "", "a\nb", "plain", "é中\n\n", "x" * 50])
            out.append((n, source, rng.choice(["en", None, "-", "ñ"]), None if text is None else len(text), text))
    rng.shuffle(out)
    return out


def _frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as row", "2 as leaf", "3 as group", "4 as ident").repartition(parts)


def _found(df, **how):
    return sorted((tuple(r) for r in merkle.manifest(df, "source", "doc_id", COLUMNS, queries.tampered, **how).collect()), key=str)


def test_climb_leaves_whole_runs_to_others():
    for total in (1, 2, 3, 4, 9, 10, 27, 28, 50):
        leaves = [bytes([i]) * 32 for i in range(total)]
        for cut in range(1, total):
            known = {}
            for start, own in ((0, leaves[:cut]), (cut, leaves[cut:])):
                levels, ragged = merkle.climb(own, start, total)
                for level, i, d in ragged:
                    known[level, i] = d
                assert len(ragged) <= 4 * len(levels)
            for level in range(merkle.depth(total)):
                for run in {i // 3 for n, i in list(known) if n == level}:
                    known[level + 1, run] = merkle.parent([known[level, i] for i in range(3 * run, min(3 * run + 3, merkle.width(total, level)))])
            assert known[merkle.depth(total), 0] == merkle.climb(leaves, 0, total)[1][0][2]


@pytest.mark.parametrize(("rows", "band"), [(10, 1), (23, 2), (100_000, 6)])
def test_against_brute_force(spark, rows, band):
    data = _rows([("hot", 170), (None, 7), ("", 1), ("é", 27), ("z", 3), ("\U0001f600", 4), ("￿", 2), *[(f"s{i}", 1 + i % 5) for i in range(25)]])
    data += [(None, "hot", "en", 1, "x\ny"), (None, None, None, None, None), (5, "hot", "en", 3, "a\nb"), (5, "hot", "de", 3, "a\nb")] + [(6, "hot", None, None, "same\n")] * 40
    got = _found(_frame(spark, data), rows=rows, band=band)
    assert got == brute(data)
    assert {r[-1] for r in got} == {True, False}


def test_small_tables(spark):
    for sizes in ([("one", 1)], [("one", 2)], [("one", 9)], [("a", 1), ("b", 1)], [(None, 1), ("b", 4)]):
        data = _rows(sizes)
        assert _found(_frame(spark, data, 1)) == brute(data)
    assert _found(_frame(spark, _rows([("one", 1)])).limit(0)) == []


def test_long_text(spark):
    data = [(1, "a", "en", 1, "line of text\n" * 200_000), (2, "a", "en", 1, "y")]
    assert _found(_frame(spark, data)) == brute(data)


def test_no_other_leaf_verifies_all(spark):
    data = _rows([("a", 20), ("b", 4)])
    found = merkle.manifest(_frame(spark, data), "source", "doc_id", COLUMNS, rows=5)
    assert found.where("verified").count() == 24


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle(spark, sf).collect()), key=str)
    assert got == brute(docs)
    assert spark.range(1).select(F.crc32(F.lit("12").cast("binary"))).first()[0] == zlib.crc32(b"12")
