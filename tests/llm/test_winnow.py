import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = _words(text)
        s = min(span, len(w))
        for i in range(len(w) - s + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + s]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for s in {len(x) for x in windows}:
            for i in range(len(w) - s + 1):
                own = windows.get(tuple(w[i : i + s]))
                if own is not None:
                    hit |= set(range(i, i + s))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_words_and_grams(spark):
    rng = random.Random(3)
    texts = [None, "", " -- ", "One", "É é A-b_C[d"] + ["".join(rng.choice("aZ09 _-@[`{~\x7f\x00\n\x85\xa0éÉ中\U0001f600İ") for _ in range(40)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", winnow.words_of(F.col("t")).alias("w")).collect()}
    assert all(got[i] == _words(t) for i, t in enumerate(texts))
    xs = [rng.randrange(100) for _ in range(40)]
    for count in range(1, 11):
        row = spark.createDataFrame([(xs,)], "x array<long>")
        small = row.select(winnow.let(F.col("x"), lambda x: winnow.rolled(x, count, lambda a, b: F.least(a, b), overlap=True)).alias("y")).first().y  # noqa: B023
        assert small[: 41 - count] == [min(xs[i : i + count]) for i in range(41 - count)]
        text = row.select(winnow.let(F.transform("x", lambda v: v.cast("string")), lambda x: winnow.rolled(x, count, lambda a, b: F.concat(a, F.lit(" "), b))).alias("y")).first().y  # noqa: B023
        assert text[: 41 - count] == [" ".join(map(str, xs[i : i + count])) for i in range(41 - count)]


def test_shared_windows_share_a_fingerprint(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        shared = [rng.choice("abcdefghijklmnop") for _ in range(10)]
        rows.append((i, [str(rng.random()) for _ in range(rng.randrange(20))] + shared + [str(rng.random()) for _ in range(20)], shared))
    df = spark.createDataFrame(rows, "i int, doc array<string>, own array<string>")
    got = df.select(F.transform(winnow.fingerprints(F.col("doc"), 10), lambda x: x["print"]).alias("a"), winnow.smallest(F.col("own"), 10).alias("b")).collect()
    assert all(len(r.b) == 1 and r.b[0] in r.a for r in got)
    assert sum(len(r.a) for r in got) < 0.5 * sum(len(d) for _, d, _ in rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "c", "É", "x1", "中文"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 14, 30]))) for i in range(40)] + [(i, "a" * i + " q" * rng.randrange(1, 9)) for i in range(40, 50)] + [(50, None), (51, "?!"), (None, text(12)), (3, text(12)), (60, "same same same same same same same same same same same same"), (61, "lone")]
    items += [(100 + i, "a passage of some twelve words that very many of the items share") for i in range(30)]
    docs = []
    for i in range(250):
        parts = [text(rng.choice([3, 12, 40]))]
        for _ in range(rng.randrange(3)):
            w = _words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts.append(rng.choice([" ", "\n"]).join(w[max(0, a - rng.randrange(14)) : a + rng.randrange(14)]))
        docs.append((i, " ".join(parts)))
    docs += [(300, None), (301, ""), (302, "--"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (303, "same " * 3000), (304, " ".join(rng.choice(words) for _ in range(20_000))), (305, "lone"), (306, items[-1][1].upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as id", "3 as print", "4 as span").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as set_id", "2 as words")
    want = brute(docs, items)
    assert sum(r[-1] for r in want) > 50
    assert _sorted(winnow.contamination(frame, asked)) == want
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # joins by shuffles alone
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert _sorted(winnow.contamination(frame, asked)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert _sorted(winnow.contamination(frame, asked.limit(0))) == brute(docs, [])
    assert winnow.contamination(frame.limit(0), asked).count() == 0


def test_query_against_its_sql_and_without_python(spark, sf):
    import duckdb

    from quarry.llm import queries

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({queries.OP12_SQL})").fetchall())
    found = queries.op12_winnowing(spark, sf)
    assert any(r[-1] for r in want) and sorted(tuple(r) for r in found.collect()) == want
    assert "Python" not in found._jdf.queryExecution().toString()
