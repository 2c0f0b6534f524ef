import math
import random

from quarry.llm import topk


def test_against_brute_force(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.choice([-1.5, 0.0, 0.25, rng.random()]) for _ in range(5)]) for i in range(300)]
    vecs += [(300, None), (320, []), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] * 5), (380, [float("inf")] * 5), (400, [1.0, 2.0]), (420, [3.0, 1.0]), (7, vecs[7][1]), (None, [1.0] * 5), (440, [1e12] * 5), (441, [-1e12, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as task")
    rows = topk.quantised(df, "vec_id", "embedding")
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for qi, q in ok:
        if qi % 20 == 0 and qi < 430:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi and len(v) == len(q))[:4]
            want |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    for shard_rows in (37, 10_000):
        got = topk.top_k(rows.where("id % 20 = 0 and id < 430"), rows, k=4, tile=7, shard_rows=shard_rows, fan=2).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(rows.limit(0), rows).count() == 0


def test_repeated_queries_have_lists_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (1, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as copies", "3 as mark", "4 as query_id")
    v = topk.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(v.where("id % 20 = 0"), v, k=2).collect())
    want = sorted([(20, 1, 1, 4096), (20, 2, 1, 4096)] + [(20, 1, 2, 4096), (20, 2, 1, 2048)] * 2)
    assert got == want


def test_query_against_its_sql(spark, sf):
    import duckdb

    from quarry.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP9_SQL})").fetchall())
    assert want and sorted(tuple(r) for r in queries.op9_topk(spark, sf).collect()) == want
