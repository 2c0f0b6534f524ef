import math
import random
import re

import numpy as np

from quarry.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def _brute_force(docs, items, k):
    terms = [(i, _terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    found = []
    for item, text in items:
        scored = []
        for i, t in terms:
            m = 100 - 25 + (25 * len(t) * n) // total
            score = 0
            for x in _terms(text):
                tf = t.count(x)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def test_terms():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 _-@[`{~\x7f\x00\n\x85\xa0éÉ中\U0001f600") for _ in range(30))
        assert [t.decode() for t in lexsearch.terms_of(text.encode())] == _terms(text), text
    assert lexsearch.terms_of(None) == [] == lexsearch.terms_of(b" -- ")


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "GAMMA", "d", "É", "é", "x1", "中文", "rare", "common"]

    def text(n):
        return rng.choice([" ", "-", "\n"]).join(rng.choice(words[:8] if rng.random() < 0.9 else words) for _ in range(n))

    docs = [(i, text(rng.choice([1, 5, 40]))) for i in range(300)] + [(300, None), (301, ""), (302, "--"), (None, "rare rare d"), (5, "alpha beta"), (5, "alpha beta"), (303, "common " * 20_000)]
    docs += [(1000 + i, "copy of rare words") for i in range(60)]  # ties at the edge
    items = [(i, text(rng.choice([1, 12]))) for i in range(25)] + [(25, None), (26, "?"), (27, "nowhere"), (None, "rare d"), (3, "rare copy"), (3, "rare copy"), (28, "common " * 500)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as item", "3 as text_", "4 as score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id", "3 as term")
    want = _brute_force(docs, items, 7)
    for block, parts in ((1 << 20, 3), (40, 9)):
        got = lexsearch.search(frame.repartition(parts), asked, 7, block=block, fan=2).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert lexsearch.search(frame, asked.limit(0)).count() == 0
    assert lexsearch.search(frame.limit(0), asked).count() == 0


def test_long_factors_do_not_overflow():
    n = np.array([10, 10**9])
    assert lexsearch.length_factor(n, 10**11, 10**13).tolist() == [75 + 25 * x * 10**11 // 10**13 for x in (10, 10**9)]


def test_query_against_its_sql(spark, sf):
    import duckdb

    from quarry.llm import queries

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(db.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP11_SQL})").fetchall())
    assert want and sorted(tuple(r) for r in queries.op11_search(spark, sf).collect()) == want
