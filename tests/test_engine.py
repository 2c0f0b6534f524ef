import json

import pytest
from pyspark.sql import functions as F

from quarry import render
from quarry.operators.embed import BatchEmbedder, HashingEmbedder
from quarry.operators.hybrid import overlap_reranker
from quarry.operators.items import SearchFilters
from quarry.plans.engine import EmptyIndex, Engine
from quarry.plans.index import build_index
from quarry.plans.store import ModelMismatch, SnapshotStore
from quarry.sources import library
from quarry.streaming.incremental import index_stream

LONG = "Retrieval of documents by words and vectors, explained at some length for the sake of the test. " * 40


def _record(key, version=1, **data):
    return json.dumps({"key": key, "version": version, "data": {"key": key, "version": version, **data}})


def _records(folder, pages):
    return [
        _record("AAA", 3, itemType="journalArticle", title="Foxes and hedgehogs", creators=[{"creatorType": "author", "firstName": "Ann", "lastName": "Lee"}, {"creatorType": "editor", "name": "The Club"}],
                tags=[{"tag": "animals"}, {"tag": "x, y", "type": 1}], collections=["C1"], date="2020", DOI="10.1/x", abstractNote="About animals.", weird="kept"),
        _record("AAA1", 1, itemType="attachment", parentItem="AAA", contentType="text/html", path=f"file://{pages}/a.html"),
        _record("BBB", 1, itemType="book", title="Empty book"),
        _record("NOTE", 1, itemType="note", note="<p>Some note &amp; body.</p>"),
        _record("PIC", 1, itemType="attachment", contentType="image/png"),
        _record("PDF", 1, itemType="attachment", contentType="application/pdf", path=f"file://{pages}/d.pdf"),
        _record("ANNO", 1, itemType="annotation"),
        _record("MISS", 1, itemType="attachment", contentType="text/html", path="file:///nowhere/x.html"),
    ]


@pytest.fixture
def lib(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.html").write_text(f"<html><body><script>no()</script><article><p>{LONG}</p></article></body></html>")
    (pages / "d.pdf").write_bytes(b"%PDF")
    source = tmp_path / "items"
    source.mkdir()
    (source / "1.json").write_text("\n".join(_records(source, pages)))
    reports = spark.createDataFrame([(f"{pages}/d.pdf", 1, [], "pdf words here", None)], "location string, page_count int, failed_pages array<int>, text string, document_error string")
    return source, pages, reports, str(tmp_path / "index")


def _build(spark, lib, **options):
    source, pages, reports, root = lib
    store = SnapshotStore(spark, root, "hashing-16", 16)
    items = library.read_items(spark, str(source))
    return store, items, build_index(store, items, HashingEmbedder(16), library.read_files(spark, str(pages)), reports, **options)


def test_index_run_search_and_catalogue(spark, lib):
    store, items, first = _build(spark, lib)
    assert (first.added, first.deleted, first.item_count) == (7, 0, 6) and store.integrity() is None
    status = {r.item_key: (r.status, r.detail) for r in store.table("status").collect()}
    assert status == {
        "AAA": ("ok", "html snapshot: extracted (readability)"), "BBB": ("no-attachment", "no PDF or HTML attachment found"), "NOTE": ("ok", "note content"),
        "PIC": ("no-attachment", "standalone attachment (image/png): not extractable"), "PDF": ("ok", "standalone PDF: extracted"),
        "MISS": ("no-attachment", "standalone html snapshot: file missing on disk"),
    }
    again = _build(spark, lib)[2]
    assert (again.added, again.retried, again.reindexed) == (0, 0, 0) and again.chunk_count == first.chunk_count

    engine = Engine(SnapshotStore(spark, lib[3], "hashing-16", 16), HashingEmbedder(16), items)
    hits = engine.search("vectors of documents", limit=3)
    rows = hits.collect()
    assert rows[0].key == "AAA" and len({r.key for r in rows}) == len(rows) <= 3
    assert [r.key for r in engine.search("note", filters=SearchFilters(item_type="note")).collect()] == ["NOTE"]
    assert engine.search("documents", filters=SearchFilters(tag="x, y")).first().key == "AAA"
    assert engine.search("vectors", limit=2, reranker=overlap_reranker).first().score == 1.0
    assert engine.sync_note() is None and Engine(engine.store, engine.embedder).sync_note().startswith("Note: the library can't be read")
    assert [r.author for r in engine.authors().collect()] == ["Lee, Ann", "The Club"]
    assert [(r.tag, r.num_items) for r in engine.tags("X").collect()] == [("x, y", 1)]
    assert [r.key for r in engine.find("fox lee").collect()] == ["AAA"] and engine.find("kept").count() == 0 and engine.find("kept", everything=True).count() == 1
    assert [r.key for r in engine.find("", sort="title", descending=True).collect()] == ["AAA", "BBB"]
    item = engine.get("AAA")
    assert [c.role for c in item.first().creators] == ["author", "editor"]
    part = engine.fulltext("AAA", start=0, end=9).first()
    assert part.text == "Retrieval" and part.total_chars == len(LONG.strip()) and engine.has_fulltext("AAA") and not engine.has_fulltext("BBB") and not engine.has_fulltext("nope")
    assert engine.title_of("AAA") == "Foxes and hedgehogs" and engine.status_of("NOTE").status == "ok" and engine.item_chunks("AAA").count() == 4 and engine.chunk("AAA_0").first().char_end == 1500
    assert [r.key for r in engine.issues().collect()] == ["BBB", "MISS", "PIC"]
    state = engine.status()
    assert state["status_breakdown"] == [("ok", 3), ("no-attachment", 3)] and state["items_without_fulltext"] == 3

    text = render.search_text(hits, "vectors of documents", "Note")
    assert text.startswith('Note\n\nSearch: "vectors of documents"\nResults: ') and "\n1. [AAA] Foxes and hedgehogs (score: 0." in text and "chars " in text
    assert render.find_text(engine.find("fox"), "fox") == 'Find: "fox"\nResults: 1\n\n1. [AAA] Foxes and hedgehogs\n   Lee, Ann | 2020 | journalArticle\n   tags: animals, x, y\n'
    assert "Authors: Lee, Ann; The Club\nDate: 2020\nDOI: 10.1/x\nTags: animals, x, y\n\nAbstract:\nAbout animals.\n" in render.item_lines(item).first().text
    assert render.issues_text(engine.issues()).startswith("Extraction issues: 3\n\n[BBB] Empty book\n  status: no-attachment\n  detail: no PDF")
    assert render.status_text(state).splitlines()[1] == "  Items: 6" and render.pdf_text("K", None) == "No PDF found for item K"
    doc = json.loads(render.json_document(engine.find("fox"), query="fox"))
    assert doc["result_count"] == 1 and doc["results"][0]["tags"] == ["animals", "x, y"]
    assert render.tag_lines(engine.tags("animals")).first().text == "  animals (1)\n" and render.fulltext_lines(engine.fulltext("AAA", end=3)).first().text.endswith("\n\nRet")


def test_changes_deletes_and_protection(spark, lib):
    source, pages, _, _ = lib
    _build(spark, lib)
    records = _records(source, pages)
    records[0] = records[0].replace('"version": 3', '"version": 4').replace("Foxes and", "Wolves and")
    del records[3]
    (pages / "a.html").write_text(" ")
    (source / "1.json").write_text("\n".join(records))
    store, _, run = _build(spark, lib)
    assert (run.added, run.deleted, run.protected, run.reindexed) == (1, 1, 1, 0)
    row = store.table("status").where("item_key = 'AAA'").first()
    assert row.status == "failed" and row.version == 4 and store.table("chunks").where("item_key = 'AAA'").count() == 4
    assert store.table("chunks").where("item_key = 'NOTE'").count() == store.table("status").where("item_key = 'NOTE'").count() == store.table("versions").where("item_key = 'NOTE'").count() == 0
    (pages / "a.html").write_text(f"<p>{LONG}</p>")
    store, _, run = _build(spark, lib)
    assert (run.retried, run.reindexed, run.unchanged) == (1, 1, 0)
    assert store.table("chunks").where("chunk_id = 'AAA_meta'").first().title == "Wolves and hedgehogs"
    store, _, run = _build(spark, lib, force=True)
    assert run.reindexed == 5 and run.item_count == 5


def test_store_guards(spark, lib):
    with pytest.raises(EmptyIndex):
        Engine(SnapshotStore(spark, lib[3], "m", 16), HashingEmbedder(16)).search("x")
    _build(spark, lib)
    with pytest.raises(ModelMismatch):
        SnapshotStore(spark, lib[3], "other", 16)
    assert SnapshotStore(spark, lib[3], "other", 16, force=True).number == 1
    with pytest.raises(library.SourceUnavailable):
        library.read_items(spark, lib[3] + "/nothing")


def _bytes(root, names):
    return sum(f.stat().st_size for n in names for f in (root / n).rglob("*.parquet"))


def test_segments_grow_with_the_change_and_merge(spark, lib, tmp_path, monkeypatch):
    from quarry.plans import store as module

    source, pages, reports, root = lib
    many = "\n".join(_record(f"N{i:04d}", 1, itemType="note", note=f"<p>{LONG} {i}</p>") for i in range(300))  # beside which the fixed size of small files is little
    (source / "3.json").write_text(many)
    _build(spark, lib)
    folder = tmp_path / "index"
    first = {p.name for p in folder.iterdir() if p.name.startswith("segment-")}
    (source / "4.json").write_text(_record("ONE", 2, itemType="note", note="only one changed"))
    store, _, run = _build(spark, lib)
    assert (run.added, run.reindexed) == (1, 1)
    new = {p.name for p in folder.iterdir() if p.name.startswith("segment-")} - first
    assert len(store.segments) == 2 and _bytes(folder, new) < 0.5 * _bytes(folder, first)
    monkeypatch.setattr(module, "newest_to_merge", len)
    (source / "4.json").write_text(_record("ONE", 3, itemType="note", note="merged"))
    store, _, _ = _build(spark, lib)
    assert len(store.segments) == 1 and store.table("chunks").where("item_key = 'ONE' and chunk_type = 'fulltext'").first().text == "merged"
    assert len(store.vacuum(keep=1)) == 3
    # The snapshot is what a build at once would be.
    whole = SnapshotStore(spark, str(tmp_path / "whole"), "hashing-16", 16)
    build_index(whole, library.read_items(spark, str(source)), HashingEmbedder(16), library.read_files(spark, str(pages)), reports)
    rows = lambda s, t: sorted(str(r) for r in s.table(t).drop("zone").collect())
    for t in ("chunks", "status", "versions", "skipped", "postings", "terms", "stats"):
        assert rows(store, t) == rows(whole, t), t
    assert store.table("meta").first()[6:] == whole.table("meta").first()[6:]


class _Failing(HashingEmbedder):
    """Fails on the texts of one item."""

    def column(self, text):
        bad = F.col(text).contains("poison")
        return F.when(bad, F.raise_error(F.lit("no vector")).cast("array<float>")).otherwise(super().column(text))


def test_checkpoints_are_resumed(spark, lib, tmp_path):
    source, pages, reports, root = lib
    (source / "3.json").write_text("\n".join(_record(f"N{i}", 1, itemType="note", note="poison" if i == 3 else f"note {i}") for i in range(5)))
    items = library.read_items(spark, str(source))
    store = SnapshotStore(spark, root, "hashing-16", 16)
    with pytest.raises(Exception, match="no vector"):
        build_index(store, items, _Failing(16), library.read_files(spark, str(pages)), reports, checkpoint=6)
    done = {r.item_key for r in SnapshotStore(spark, root, "hashing-16", 16).table("versions").collect()}
    store = SnapshotStore(spark, root, "hashing-16", 16)
    run = build_index(store, items, HashingEmbedder(16), library.read_files(spark, str(pages)), reports, checkpoint=6)
    assert run.added == 12 - len(done) and "N3" not in done and run.item_count == 11
    assert store.integrity() is None
    broken = SnapshotStore(spark, str(tmp_path / "broken"), "m", 1)
    broken.commit(chunks=(None, store.table("chunks").withColumn("embedding", F.lit(None).cast("array<float>"))))
    with pytest.warns(UserWarning, match="vectors"):
        SnapshotStore(spark, str(tmp_path / "broken"), "m", 1)


def test_stream(spark, lib, tmp_path):
    source, pages, reports, root = lib
    store, embedder = SnapshotStore(spark, root, "hashing-16", 16), HashingEmbedder(16)
    run = lambda: index_stream(spark, str(source), store, embedder, str(tmp_path / "check"), library.read_files(spark, str(pages)), reports).awaitTermination()
    run()
    assert store.table("meta").first().item_count == 6
    (source / "2.json").write_text(_record("NEW", 1, itemType="note", note="fresh words") + "\n" + _record("NOTE", 2, itemType="note", note="changed"))
    run()
    rows = {r.chunk_id: r.text for r in store.table("chunks").where("chunk_type = 'fulltext'").collect()}
    assert rows["NEW_0"] == "fresh words" and rows["NOTE_0"] == "changed" and store.table("meta").first().item_count == 7


def test_a_stream_with_deletions_and_late_attachments(spark, tmp_path):
    """The state after all batches is that of one build over what is left."""
    source, pages = tmp_path / "items", tmp_path / "pages"
    source.mkdir()
    pages.mkdir()
    for n in "abcd":
        (pages / f"{n}.html").write_text(f"<p>{LONG} file {n}</p>")
    page = lambda key, parent, n, v=1: _record(key, v, itemType="attachment", parentItem=parent, contentType="text/html", path=f"file://{pages}/{n}.html")
    gone = lambda key, v=9: json.dumps({"key": key, "version": v, "deleted": True})
    batches = [
        [_record("W1", 1, itemType="book", title="One"), _record("W2", 1, itemType="book", title="Two"), _record("W3", 1, itemType="book", title="Three"), page("A3", "W3", "c"), page("EARLY", "W4", "d")],
        [page("A1", "W1", "a"), gone("W2"), _record("W4", 2, itemType="book", title="Four")],  # a file a batch later; a work after its file
        [page("A1", "W3", "a", 2), gone("A3"), _record("W5", 1, itemType="book", title="Five"), gone("W5", 1)],  # moved, deleted, and both in a batch
    ]
    store, embedder, files = SnapshotStore(spark, str(tmp_path / "stream"), "hashing-16", 16), HashingEmbedder(16), library.Files(spark, str(pages))
    texts = []
    for n, lines in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(lines))
        index_stream(spark, str(source), store, embedder, str(tmp_path / "check"), files).awaitTermination()
        texts.append({r.item_key: r.fulltext[-6:] for r in store.table("chunks").where("chunk_type = 'metadata' and coalesce(fulltext, '') <> ''").collect()})
    assert texts == [{"W3": "file c"}, {"W1": "file a", "W3": "file c", "W4": "file d"}, {"W1": "file a", "W3": "file a", "W4": "file d"}]
    # W1's file has moved away: what was indexed of it is kept, as after any extraction that finds nothing.
    assert {r.item_key: r.status for r in store.table("status").collect()} == {"W1": "no-attachment", "W3": "ok", "W4": "ok"}
    left = tmp_path / "left"
    left.mkdir()
    (left / "all.json").write_text("\n".join([_record("W3", 1, itemType="book", title="Three"), page("A1", "W3", "a", 2), _record("W4", 2, itemType="book", title="Four"), page("EARLY", "W4", "d")]))
    whole = SnapshotStore(spark, str(tmp_path / "whole"), "hashing-16", 16)
    build_index(whole, library.read_items(spark, str(left)), embedder, files)
    rows = lambda s, t: sorted(str(r) for r in s.table(t).where("item_key <> 'W1'").drop("zone").collect())
    for t in ("chunks", "status", "versions"):
        assert rows(store, t) == rows(whole, t), t


def test_batch_embedder(spark):
    e = BatchEmbedder("lengths", 1, lambda: lambda texts: [[float(len(t))] for t in texts], batch=2)
    df = spark.createDataFrame([("a",), ("bbb",), (None,)], "t string")
    assert [r.v for r in df.select(e.column("t").alias("v")).collect()] == [[1.0], [3.0], [0.0]] and e.one("xx") == [2.0]
    h = HashingEmbedder(16)
    assert spark.createDataFrame([("A b a",)], "t string").select(h.column("t").alias("v")).first().v == h.one("a B a")


def test_a_run_opens_only_the_files_it_needs(spark, tmp_path):
    """What one changed item needs is opened; all other files have been deleted since they were listed."""
    source, pages = tmp_path / "items", tmp_path / "pages"
    source.mkdir()
    pages.mkdir()
    for n in range(6):
        (pages / f"a [{n}] {{x}}.html").write_text(f"<p>{LONG} number {n}</p>")
        (pages / f"d{n}.pdf").write_bytes(f"words of {n}".encode())

    def records(version):
        out = []
        for n in range(6):
            v = version if n == 2 else 1
            out += [_record(f"H{n}", v, itemType="book", title=f"page {n} {v}"), _record(f"H{n}A", 1, itemType="attachment", parentItem=f"H{n}", contentType="text/html", path=f"file://{pages}/a%20%5B{n}%5D%20%7Bx%7D.html")]
            out += [_record(f"P{n}", v, itemType="book", title=f"file {n} {v}"), _record(f"P{n}A", 1, itemType="attachment", parentItem=f"P{n}", contentType="application/pdf", path=f"file://{pages}/d{n}.pdf")]
        return "\n".join(out)

    def read(found):
        return found.select("location", F.lit(1).alias("page_count"), F.array().cast("array<int>").alias("failed_pages"), F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("document_error"))

    (source / "1.json").write_text(records(1))
    store = SnapshotStore(spark, str(tmp_path / "index"), "hashing-16", 16)
    files = library.Files(spark, str(pages))
    run = lambda f: build_index(store, library.read_items(spark, str(source)), HashingEmbedder(16), f, read)
    assert run(files).added == 12
    assert {r.status for r in store.table("status").collect()} == {"ok"}

    class Listed(library.Files):
        """Lists what was there before most files went."""

        def listing(self):
            return before

    before = spark.createDataFrame(files.listing().collect(), "location string, size long")
    kept = {"a [2] {x}.html", "d2.pdf"}
    for f in pages.iterdir():
        if f.name not in kept:
            f.unlink()
    (source / "1.json").write_text(records(2))
    again = run(Listed(spark, str(pages)))
    assert (again.added, again.unchanged + again.reindexed) == (2, 2)
    assert {r.item_key for r in store.table("status").where("status <> 'ok'").collect()} == set()
    # A file that went after it was listed: the others are read all the same.
    wanted = spark.createDataFrame([(f"{pages}/d2.pdf",), (f"{pages}/d1.pdf",)], "location string")
    assert [r.location for r in files.contents(wanted).collect()] == [f"{pages}/d2.pdf"]
    assert files.contents(wanted.limit(0)).count() == 0 and "content" not in files.listing().columns


def test_index_run_on_odd_rows_equals_sql(spark, tmp_path):
    """Documents without a language or a text, and a text longer than what the engine keeps by default."""
    import duckdb

    from quarry.core_queries import index_run
    from quarry.oracles import ORACLES

    texts = [("plain words", None), (None, "en"), (None, "fr"), ("words é " * 262_144, "de"), ("é" * 20_801, "fr")]
    rows = [(10 * i + k, t, lang, "s1") for i, (t, lang) in enumerate(texts) for k in range(5) if len(t or "") < 1 << 20 or k == 0]
    labels = [(d, q, x) for d, *_ in rows for k, q, x in [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1)] if d % 10 == k]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    key = lambda r: r[0]
    assert sorted(map(tuple, index_run(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(ORACLES["index_run"]).fetchall(), key=key)
