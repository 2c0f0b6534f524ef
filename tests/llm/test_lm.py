import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import lm


def brute(docs, order, whole=True):
    """Katz backoff with dictionaries: [(n_tokens, n_known, N, base, score)] by document, and each distribution's sum."""
    tokens = [[w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()] + ["end"] for _, t in docs]
    train = [x for (i, _), x in zip(docs, tokens) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    count = Counter(w for x in train for w in x)
    n, v = sum(count.values()), len(count)

    def discounts(counts):
        seen = Counter(counts)
        common = 6 * seen[6] / seen[1] if seen[1] else math.inf
        d = {}
        for r in range(1, 6):
            d[r] = ((r + 1) * seen[r + 1] / (r * seen[r]) - common) / (1 - common) if seen[r] and seen[1] and common != 1 else -1
            if not 0 < d[r] < 1:
                d[r] = (r - 0.5) / r
        return d

    def level(counts, d, lower):
        """Probabilities after one context: {word: P}, None for all others as a factor of lower."""
        total = sum(counts.values())
        kept = {w: d.get(c, 1) * c for w, c in counts.items()}
        left = max(1 - sum(kept.values()) / total, 1 / (total + 1))
        scale = (1 - left) / sum(kept.values())
        return {w: k * scale for w, k in kept.items()}, left / (1 - sum(lower(w) for w in counts))

    if n:
        d = discounts(count.values())
        kept = {w: d.get(c, 1) * c for w, c in count.items()}
        left = max(1 - sum(kept.values()) / n, 1 / (n + 1))
        uni = {w: k * (1 - left) / sum(kept.values()) for w, k in kept.items()}
    else:
        uni, left = {}, 1.0
    models = {1: {(): (uni, left)}}

    def p(word, context):
        k = len(context) + 1
        own = models[k].get(context)
        if k == 1:
            return own[0].get(word, own[1])
        if own is None:
            return p(word, context[1:])
        return own[0][word] if word in own[0] else own[1] * p(word, context[1:])

    for k in range(2, order + 1):
        after = defaultdict(Counter)
        for x in train:
            x = ["start", *x]
            for i in range(k - 1, len(x)):
                after[tuple(x[i - k + 1 : i])][x[i]] += 1
        d = discounts([c for own in after.values() for c in own.values()])
        models[k] = {context: level(own, d, lambda w, context=context: p(w, context[1:])) for context, own in after.items()}
    sums = [sum(p(w, context) for w in [*count, "never seen"]) for k in models for context in models[k]] if whole else []
    out = []
    for x in tokens:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        y = ["start", *x]
        score = sum(math.log10(p(y[i], tuple(y[max(0, i - order + 1) : i]))) for i in range(1, len(y))) if order > 1 else sum(math.log10(p(w, ())) for w in x)
        out.append((len(x), sum(count[w] > 0 for w in x), n, base, score))
    return out, sums


def corpus():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(names[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return [*docs, (None, None), (7, ""), (7, "THE The the\x0bé É"), (30, "new words only"), (30, "new words only"), (8, "w1 w2 w0 " * 150)]


def check(spark, docs, order):
    want, total = brute(docs, order)
    assert all(abs(s - 1) < 1e-9 for s in total)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as n", "3 as score", "4 as chunk")
    got = lm.score(df, order=order).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, *(round(x, 5) for x in r[1:]))
    have = sorted(key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(key((i, *w)) for (i, _), w in zip(docs, want)), strict=True):
        assert a == pytest.approx(b, abs=3e-5)


# Whole; in small chunks, so that texts are cut, and many buckets; with all frequent contexts dealt over buckets.
@pytest.mark.parametrize(("order", "chunk", "bucket", "hot"), [(1, 300, 50, 20), (2, 1 << 21, 1 << 21, 1 << 23), (2, 300, 200, 20), (3, 300, 100, 1 << 23), (3, 70, 300, 5), (4, 200, 400, 3)])
def test_against_brute_force(spark, monkeypatch, order, chunk, bucket, hot):
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("HOT", hot)):
        monkeypatch.setattr(lm, name, value)
    check(spark, corpus(), order)


def test_without_training_rows(spark):
    df = spark.createDataFrame([(i, t) for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0 for t in ["a b", None]], "doc_id long, text string")
    for r in lm.score(df, order=3).collect():
        assert (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0) and r.base_score == pytest.approx(0.0, abs=1e-9)
    assert lm.score(df.limit(0)).count() == 0


def test_query(spark, sf):
    from quarry.llm import queries

    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(docs, brute(docs, queries.LM_ORDER, False)[0])}
    got = queries.op8_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 2**62, 500)), rng.integers(0, 3, 400), np.empty(0, np.int64), np.zeros(9, np.int64)]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)
    for x in arrays:
        assert (lm.unpack_few(*lm.unpack(lm.pack(*lm.pack_few(x)))) == x).all()
