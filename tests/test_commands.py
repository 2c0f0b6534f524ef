import json

from quarry import __main__ as cli
from quarry.operators import documents
from quarry.operators.hybrid import batch_reranker

from .test_engine import lib  # noqa: F401  a fixture


def test_commands(spark, lib, capsys):  # noqa: F811
    source, pages, _, root = lib

    def run(*args, code=0):
        parsed = cli.parser().parse_args(["--library", str(source), "--index", root, "--files", str(pages), "--dim", "16", *args])
        if code:
            try:
                cli.answer(spark, parsed)
            except Exception as e:  # noqa: BLE001
                return str(e)
            raise AssertionError("no error")
        return cli.answer(spark, parsed)

    assert "empty" in run("search", "x", code=1)
    assert run("index").startswith("Done. 7 new or changed, 0 deleted")
    assert json.loads(run("--json", "search", "vectors", "--limit", "1"))["results"][0]["key"] == "AAA"
    assert 'Find: "fox"' in run("find", "fox", "--tag", "animals") and json.loads(run("--json", "get", "AAA"))["doi"] == "10.1/x"
    assert "no item" in run("get", "NOPE", code=1) and run("pdf", "AAA") == "No PDF found for item AAA"
    assert run("fulltext", "AAA", "--end", "9").endswith("\n\nRetrieval") and "beyond" in run("fulltext", "AAA", "--start", "99999", code=1)
    assert run("tags", "--contains", "ANI") == "Tags: 1\n\n  animals (1)\n" and run("authors").startswith("Authors: 2\n\n  Lee, Ann\n")
    assert "Items: 6" in run("index", "status") and json.loads(run("--json", "index", "issues"))["count"] == 4


def test_reports(spark):
    def extractor(content):
        if content == b"crash":
            raise ValueError("no trailer")
        if content == b"memory":
            bytearray(8 << 30)
        yield 2
        yield content.decode()
        yield ValueError("page")

    files = spark.createDataFrame([("a", 3, b"one"), ("b", 5, b"crash"), ("c", 6, b"memory"), ("d", 200 * 1024 * 1024, b"")], "location string, size long, content binary")
    got = {r.location: r for r in documents.reports(files, extractor).collect()}
    assert (got["a"].page_count, got["a"].failed_pages, got["a"].text, got["a"].document_error) == (2, [2], "one", None)
    assert got["b"].document_error == "ValueError: no trailer" and "MemoryError" in got["c"].document_error and "d" not in got


def test_batch_reranker(spark):
    df = spark.createDataFrame([("aa",), ("b",), (None,)], "t string")
    score = batch_reranker(lambda: lambda q, texts: [len(q) + len(t) for t in texts], batch=2)("qq")
    assert [r.s for r in df.select(score(df.t).alias("s")).collect()] == [4.0, 3.0, 2.0]
