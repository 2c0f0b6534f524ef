import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, hybrid, items, lexical, sync, vector
from quarry.operators.items import SearchFilters

V = "item_key string, version long"


def test_diff_classifies(spark):
    local = spark.createDataFrame([("KEPT", 3), ("MOVED", 3), ("LOST", 9)], V)
    remote = spark.createDataFrame([("KEPT", 3), ("MOVED", 4), ("FRESH", 1)], V)
    assert {(r.item_key, r.action) for r in sync.diff(remote, local).collect()} == {("MOVED", "add"), ("FRESH", "add"), ("LOST", "delete")}
    assert sync.diff(local, local).count() == 0
    assert {r.action for r in sync.diff(spark.createDataFrame([("MOVED", 2)], V), local.where("item_key = 'MOVED'")).collect()} == {"add"}


def test_rebuilt_versions(spark):
    known = spark.createDataFrame([("STAYS", 5), ("LEAVES", 7)], V)
    remote = spark.createDataFrame([("STAYS", 5), ("COMES", 10), ("BREAKS", 11)], V)
    done = spark.createDataFrame([("COMES", 10)], V)
    assert {tuple(r) for r in sync.rebuilt_versions(known, remote, done).collect()} == {("STAYS", 5), ("COMES", 10)}


def test_retry_sets(spark):
    status = spark.createDataFrame([("BARE_EARLY", "no-attachment", 0), ("BARE_LATE", "no-attachment", 2), ("FINE_EARLY", "ok", 0), ("BAD", "failed", 2), ("LOST", "partial", 2)], "item_key string, status string, status_version int")
    assert {r.item_key for r in sync.stale(status).collect()} == {"BARE_EARLY"}
    metas = spark.createDataFrame([("CUT", "text"), ("BARE", ""), ("BARE_LATE", "")], "item_key string, fulltext string")
    versions = spark.createDataFrame([("CUT", 1), ("PASSED", 2)], V)
    assert {r.item_key for r in sync.unchunked(versions, metas).collect()} == {"PASSED"}
    assert sync.unchunked(versions, metas, versions.where("item_key = 'PASSED'")).count() == 0
    assert {r.item_key for r in sync.untracked(metas, status).collect()} == {"BARE"}
    remote = spark.createDataFrame([(k, 1) for k in ("BARE_EARLY", "BAD", "BARE", "PASSED", "QUEUED")], V)
    changes = spark.createDataFrame([("PASSED", "add")], "item_key string, action string")
    assert {r.item_key for r in sync.retry_keys(status, metas, versions, remote, changes).collect()} == {"BARE_EARLY", "BAD", "BARE"}


def test_upsert_and_delete_leave_prefixes_alone(spark):
    c = "chunk_id string, item_key string"
    old = spark.createDataFrame([("SEAS_meta", "SEAS"), ("SEAS_0", "SEAS"), ("SEA_meta", "SEA"), ("SEA_0", "SEA"), ("SEA_1", "SEA")], c)
    new = spark.createDataFrame([("SEA_meta", "SEA"), ("SEA_0", "SEA")], c)
    assert sorted(r.chunk_id for r in sync.upsert(old, new, new).collect()) == ["SEAS_0", "SEAS_meta", "SEA_0", "SEA_meta"]
    assert {r.item_key for r in sync.delete(old, new).collect()} == {"SEAS"}


def _corpus(spark):
    rows = [("a_0", "a", "red fox jumps over red fence", "Fox", ["x"], "article"), ("a_1", "a", "blue fox", "Fox", ["x"], "article"), ("b_0", "b", "red paint", "Paint", ["x", "y"], "book"), ("c_0", "c", "nothing here", "Fence", [], "book")]
    return spark.createDataFrame(rows, "chunk_id string, item_key string, text string, title string, tags array<string>, item_type string").withColumn("creators", F.lit("")).withColumn("collections", F.array("item_type"))


def _bm25(docs, field, term):
    toks = [d[field].lower().split() for d in docs]
    df = sum(term in t for t in toks)
    avg = sum(map(len, toks)) / len(toks)
    idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
    return [idf * t.count(term) * 2.2 / (t.count(term) + 1.2 * (0.25 + 0.75 * len(t) / avg)) if term in t else 0.0 for t in toks]


def test_bm25_and_grammar(spark):
    chunks = _corpus(spark)
    docs = [r.asDict() for r in chunks.orderBy("chunk_id").collect()]
    found, stats = lexical.postings(chunks), lexical.statistics(chunks)
    scores = lambda q: {r.chunk_id: r.score for r in lexical.evaluate(lexical.parse(q), found, stats).collect()}
    want = [sum(_bm25(docs, f, t)[i] for f in ("text", "title") for t in ("red", "fox")) for i in range(4)]
    assert {k: pytest.approx(v) for k, v in scores("red fox").items()} == {d["chunk_id"]: v for d, v in zip(docs, want) if v}
    assert set(scores("+red fox")) == {"a_0", "b_0"}
    assert set(scores("red -fox")) == {"b_0"}
    assert set(scores("red AND fox")) == {"a_0"}
    assert set(scores('"red fence"')) == {"a_0"} and not scores('"fence red"')
    assert set(scores("title:fence")) == {"c_0"} and set(scores("(blue OR paint) AND NOT red")) == {"a_1"}
    assert scores("title:fence^3")["c_0"] == pytest.approx(3 * scores("title:fence")["c_0"])
    for bad in ("", "(red", "red)", "AND red", "nofield:x", '"'):
        with pytest.raises(lexical.QueryError):
            lexical.parse(bad)
    # Ranges and sets have a fixed score; slop, beginnings, escapes and * widen what matches.
    assert scores("title:[fence TO fox]^2") == {"a_0": 2.0, "a_1": 2.0, "c_0": 2.0} and set(scores("title:{fence TO fox]")) == {"a_0", "a_1"}
    assert set(scores("title:>=paint")) == {"b_0"} == set(scores("title:{fox TO *}")) and set(scores("title:<fox")) == {"c_0"}
    assert scores("title: IN [paint fence zzz]") == {"b_0": 1.0, "c_0": 1.0} and set(scores("*")) == {"a_0", "a_1", "b_0", "c_0"} and set(scores("* -red")) == {"a_1", "c_0"}
    assert not scores('"red jumps"') and set(scores('"red jumps"~1')) == {"a_0"} and set(scores('"fox red"~2')) == {"a_0"} and not scores('"fox red"~1')
    assert set(scores('"red fo"*')) == {"a_0"} and scores('"pai"*') == {"b_0": 1.0} and set(scores("red\\-fence")) == {"a_0"}
    assert scores('text:"red fox" fox')["a_0"] == pytest.approx(scores('text:"red fox"')["a_0"] + scores("fox")["a_0"])
    stemmed = lexical.search(chunks, "jumping", 5)
    assert [r.chunk_id for r in stemmed.collect()] == ["a_0"]
    only = lexical.search(chunks, "red", 5, SearchFilters(tag="y"))
    assert [r.chunk_id for r in only.collect()] == ["b_0"]


def test_filters(spark):
    c = _corpus(spark).withColumn("creators", F.when(F.col("item_key") == "b", "Doe, Jane").otherwise(""))
    keys = lambda f: sorted(r.chunk_id for r in f.apply(c).collect())
    assert keys(SearchFilters(tag="X")) == [] and keys(SearchFilters(tag="x", item_type="book")) == ["b_0"] and keys(SearchFilters(collection="article")) == ["a_0", "a_1"]
    assert keys(SearchFilters(creator="JANE")) == ["b_0"] and not SearchFilters().any() and SearchFilters(creator="").any()


def test_vector_search_filters_first(spark):
    rows = [("a_0", "a", [1.0, 0.0], "p"), ("b_0", "b", [0.9, 0.1], "q"), ("c_0", "c", [0.0, 1.0], "q"), ("d_0", "d", None, "q"), ("e_0", "e", [0.0, 0.0], "q")]
    c = spark.createDataFrame(rows, "chunk_id string, item_key string, embedding array<float>, item_type string")
    assert [r.chunk_id for r in vector.search(c, [1.0, 0.0], 2).collect()] == ["a_0", "b_0"]
    assert [(r.chunk_id, round(r.score, 3)) for r in vector.search(c, [1.0, 0.0], 3, SearchFilters(item_type="q")).collect()] == [("b_0", 0.994), ("c_0", 0.0), ("e_0", 0.0)]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        vector.check_dimension(c, 3).collect()


def test_fusion_and_items(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 5.0)], "chunk_id string, score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.8)], "chunk_id string, score double")
    got = {r.chunk_id: r.score for r in hybrid.fuse(a, b).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61), "z": pytest.approx(1 / 62)}
    hits = spark.createDataFrame([("i", "i_0", 1.0), ("i", "i_1", 2.0), ("j", "j_0", 2.0)], "item_key string, chunk_id string, score double")
    assert sorted((r.item_key, r.chunk_id) for r in hybrid.best_per_item(hits).collect()) == [("i", "i_1"), ("j", "j_0")]


def test_status_breakdown_and_issues(spark):
    status = spark.createDataFrame([("b", "ok", ""), ("a", "failed", "x"), ("c", "no-attachment", ""), ("d", "partial", "p"), ("e", "ok", "")], "item_key string, status string, detail string")
    assert [tuple(r) for r in catalog.status_breakdown(status, 7).collect()] == [("ok", 2), ("partial", 1), ("failed", 1), ("no-attachment", 1), ("unknown", 2)]
    titles = spark.createDataFrame([("a", "A")], "item_key string, title string")
    assert [tuple(r) for r in catalog.issues(status, titles).collect()] == [("a", "A", "failed", "x"), ("d", "", "partial", "p"), ("c", "", "no-attachment", "")]


def test_tags_and_predicates(spark):
    df = spark.createDataFrame([("1", ["b", "A"]), ("2", ["a", "b"]), ("3", [])], "item_key string, tags array<string>")
    assert [tuple(r) for r in catalog.tags(df).collect()] == [("A", 1), ("a", 1), ("b", 2)]
    assert [r.tag for r in catalog.tags(df, "a").collect()] == ["A", "a"]
    kinds = spark.createDataFrame([("book", "", ""), ("note", "", ""), ("note", "P", ""), ("attachment", "", "text/html"), ("annotation", "", "")], "item_type string, parent_item string, content_type string")
    assert [r.x for r in kinds.select(items.is_indexable().alias("x")).collect()] == [True, True, False, True, False]


def test_search_many_in_tiles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(90, None), (91, [1.0, 2.0]), (92, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {}
    for q, a in rows:
        if a is None or q % 3:
            continue
        found = []
        for i, b in rows:
            if b is not None and len(b) == len(a):
                n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                found.append((-round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0, i))
        for rank, (s, i) in enumerate(sorted(found)[:4], 1):
            want[q, rank] = (i, -s)
    for tile, shard in ((2048, 32768), (7, 11)):
        monkeypatch.setattr(vector, "TILE", tile)
        monkeypatch.setattr(vector, "SHARD", shard)
        got = vector.search_many(df, df.where("id % 3 = 0").select(F.col("id").alias("q"), "v"), 4, "id", "q", "v").collect()
        assert len(got) == len(want)
        for r in got:
            assert r.score == pytest.approx(want[r.q, r["rank"]][1], abs=1e-8)


def test_stemmed_search_over_all_chunks(spark, sf):
    """Brute force over the chunks of the documents."""
    from collections import Counter

    import regex

    from quarry import core_queries
    from quarry.functions.stem import stem

    chunks = core_queries._full_chunks(spark, sf).collect()
    terms = {f: [[stem(w) for w in regex.findall(r"[\p{L}\p{N}]+", (c[f] or "").lower()) if len(w.encode()) < 40] for c in chunks] for f in lexical.FIELDS}
    want = {}
    for f, term, boost in [*((f, t, 1) for f in lexical.FIELDS for t in ("document", "the")), ("title", "document", 2)]:
        counts = [Counter(x) for x in terms[f]]
        df, avg = sum(term in c for c in counts), sum(map(len, terms[f])) / len(chunks)
        idf = math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5))
        for c, n in zip(chunks, counts):
            if n[term]:
                want[c.chunk_id] = want.get(c.chunk_id, 0.0) + boost * idf * n[term] * 2.2 / (n[term] + 1.2 * (0.25 + 0.75 * n.total() / avg))
    que = {c.chunk_id for i, c in enumerate(chunks) if any("que" in terms[f][i] for f in lexical.FIELDS)}
    got = {r.chunk_id: r.score for r in core_queries.bm25_stemmed(spark, sf).collect()}
    assert got.keys() == want.keys() - que
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)


def _taken(rows, *columns):
    return {tuple(r[c] for c in columns) for r in rows}


def test_keyed_state_is_what_the_joins_give(spark):
    """On random tables of 60 keys, against the functions of single questions."""
    rng = random.Random(5)
    for seed in range(3):
        some = lambda n: rng.sample([f"K{i:02d}" for i in range(60)], n)
        remote = spark.createDataFrame([(k, rng.randrange(1, 3)) for k in some(45)], V)
        known = spark.createDataFrame([(k, rng.randrange(1, 3)) for k in some(45)], V)
        outcomes = ["ok", "failed", "partial", "suspicious", "no-attachment"]
        status = spark.createDataFrame([(k, rng.choice(outcomes), rng.choice([0, 2]), "t", "c") for k in some(35)], "item_key string, status string, status_version int, text_hash string, content_hash string")
        metas = spark.createDataFrame([(k, rng.choice(["", "some text"])) for k in some(40)], "item_key string, fulltext string")
        chunks = metas.select("item_key", F.lit("metadata").alias("chunk_type")).union(metas.where("fulltext <> ''").select("item_key", F.lit("fulltext")))
        skipped, asked = (spark.createDataFrame([(k,) for k in some(n)], "item_key string") for n in (6, 5))
        state = sync.keyed_state(remote, known, status, chunks, skipped, asked).persist()
        changes = sync.diff(remote, known)
        assert _taken(state.where("action is not null").collect(), "item_key", "action") == _taken(changes.collect(), "item_key", "action")
        retry = sync.retry_keys(status, metas, known, remote, changes, skipped)
        assert _taken(state.where("reason is not null").collect(), "item_key") == _taken(retry.collect(), "item_key")
        asked_there = _taken(asked.join(remote, "item_key", "left_semi").collect(), "item_key")
        queue = _taken(changes.where("action = 'add'").collect(), "item_key") | _taken(retry.collect(), "item_key") | asked_there
        assert _taken(state.where("queued").collect(), "item_key") == queue
        done = remote.where(F.col("item_key").isin(*[k for (k,) in queue]))
        assert _taken(state.where("next_version is not null").collect(), "item_key", "next_version") == _taken(sync.rebuilt_versions(known, remote, done).collect(), "item_key", "version")
        assert _taken(state.where("old_text = 't' and old_content = 'c' and tracked").collect(), "item_key") == _taken(status.collect(), "item_key")
        assert state.count() == len(_taken(remote.union(known).select("item_key").union(status.select("item_key")).union(metas.select("item_key")).union(skipped).collect(), "item_key"))


def test_keyed_state_of_nothing_of_repeated_rows_and_of_null_keys(spark):
    empty = spark.createDataFrame([], V)
    status, chunks = spark.createDataFrame([], "item_key string, status string"), spark.createDataFrame([], "item_key string, chunk_type string")
    assert sync.keyed_state(empty, empty, status, chunks).count() == 0
    remote = spark.createDataFrame([("A", 1), ("A", 1), (None, 1), ("N", None)], V)
    rows = {r.item_key: r for r in sync.keyed_state(remote, spark.createDataFrame([("N", None), ("GONE", None)], V), status, chunks).collect()}
    assert set(rows) == {"A", "N", "GONE"} and rows["A"].action == "add" and rows["GONE"].action == "delete"
    assert rows["N"].action is None and rows["N"].reason == "unchunked" and rows["N"].queued  # a version that is unknown on both sides is the same


def test_action_of_what_came_out(spark):
    rows = [(1, "x", "h", "c", "h", "c", True, True), (2, "x", "h", "c2", "h", "c", True, True), (3, "", "e", "c", "h", "c", True, True), (4, "", "e", "c", None, None, False, False), (5, "x", "h", "c", "h", "c", False, True)]
    df = spark.createDataFrame(rows, "n int, text string, text_hash string, content_hash string, old_text string, old_content string, indexed boolean, has_text boolean")
    act = lambda **o: [r.a for r in df.select("n", sync.action_of(**o).alias("a")).orderBy("n").collect()]
    assert act() == ["unchanged", "reindex", "protect", "reindex", "reindex"]
    assert act(compat_text_only=True) == ["unchanged", "unchanged", "protect", "reindex", "reindex"]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def _worded(spark):
    rows = [("A_0", "A", "the fox, the foxes and the Fox", "T one", "en"), ("A_1", "A", "", None, "en"), ("B_0", "B", None, "the", "de"), ("C_0", "C", "fox " * 3 + "hedge", "", "de")]
    return spark.createDataFrame(rows, "chunk_id string, item_key string, text string, title string, item_type string")


def test_postings_and_frequencies_come_from_each_row(spark):
    from quarry.functions.stem import stem

    c = _worded(spark)
    for stemming in (False, True):
        found = lexical.postings(c, ["text", "title"], stemming)
        assert _exchanges(found) == 0
        want = {}
        for r in c.collect():
            for f in ("text", "title"):
                terms = lexical.terms_of(r[f] or "")
                for i, t in enumerate(terms):
                    want.setdefault((f, stem(t) if stemming else t, r.chunk_id, len(terms)), []).append(i)
        assert {(r.field, r.term, r.chunk_id, r.len): r.positions for r in found.collect()} == want
        assert all(r.tf == len(r.positions) for r in found.collect())
        some = lexical.postings(c, ["text", "title"], stemming, only=["fox"])
        assert {(r.field, r.term, r.chunk_id, r.len): r.positions for r in some.collect()} == {k: v for k, v in want.items() if k[1] == "fox"}
    have = sorted(map(tuple, lexical.frequencies(c, ["text", "title"]).collect()))
    assert have == sorted(map(tuple, lexical.document_frequency(lexical.postings(c, ["text", "title"])).collect()))


def test_cosines_come_from_each_row(spark):
    from quarry.operators.embed import HashingEmbedder

    e, c = HashingEmbedder(16), _worded(spark)
    found = e.cosines(c, e.one("the fox"))
    assert _exchanges(found) == 0
    target = np.array(e.one("the fox"))
    vectors = {r.chunk_id: np.array(r.v) for r in c.select("chunk_id", e.column("text").alias("v")).collect()}
    assert {k: list(v) for k, v in vectors.items()} == {r.chunk_id: e.one(r.text or "") for r in c.collect()}
    for r in found.collect():
        length = np.linalg.norm(vectors[r.chunk_id]) * np.linalg.norm(target)
        assert r.score == pytest.approx(vectors[r.chunk_id] @ target / length if length else 0.0)


def test_scan_scores_filters_before_it_scores(spark):
    from quarry.operators.items import SearchFilters

    c, f = _worded(spark), SearchFilters(item_type="de")
    every = {r.chunk_id: r.score for r in lexical.scan_scores(c, ["fox", "the"], ["text"]).collect()}
    some = {r.chunk_id: r.score for r in lexical.scan_scores(c, ["fox", "the"], ["text"], f).collect()}
    assert some == {k: v for k, v in every.items() if k[0] in "BC"} and len(every) == 2
