"""Command line: python -m quarry --library DIR --index DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import render
from .functions.text import file_path_of
from .operators import catalog, documents
from .operators.embed import HashingEmbedder
from .operators.hybrid import overlap_reranker
from .operators.items import SearchFilters
from .plans.engine import Engine
from .plans.index import build_index
from .plans.store import SnapshotStore
from .session import get_session
from .sources import library, pdf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Hybrid search and catalogue queries over a library.")
    p.add_argument("--library", required=True, help="folder of item records (JSON lines)")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--files", help="folder of saved pages and documents")
    p.add_argument("--master", help="Spark master; default: what spark-submit gives, else local")
    p.add_argument("--dim", type=int, default=384)
    p.add_argument("--json", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--rerank", action="store_true")
    s.add_argument("--no-sync-check", action="store_true")
    for name in ("tag", "creator", "item-type", "collection"):
        s.add_argument(f"--{name}")
    f = commands.add_parser("find")
    f.add_argument("query", nargs="?", default="")
    for name in ("tag", "item-type", "collection", "creator", "sort"):
        f.add_argument(f"--{name}")
    f.add_argument("--everything", action="store_true")
    f.add_argument("--desc", action="store_true")
    f.add_argument("--limit", type=int, default=25)
    for name in ("get", "pdf"):
        commands.add_parser(name).add_argument("key")
    t = commands.add_parser("fulltext")
    t.add_argument("key")
    for name in ("start", "end", "max-chars"):
        t.add_argument(f"--{name}", type=int)
    for name in ("tags", "authors"):
        commands.add_parser(name).add_argument("--contains")
    i = commands.add_parser("index")
    i.add_argument("what", nargs="?", choices=["run", "status", "issues"], default="run")
    i.add_argument("--force", action="store_true")
    return p


def answer(spark, args) -> str:
    """What a command prints."""
    embedder = HashingEmbedder(args.dim)
    needs_index = args.command in ("search", "fulltext", "index")
    store = SnapshotStore(spark, args.index, embedder.name, embedder.dim, getattr(args, "force", False)) if needs_index else None
    local_only = args.command == "fulltext" or args.command == "index" and args.what != "run"
    try:
        items = None if local_only else library.read_items(spark, args.library)
    except library.SourceUnavailable:
        if args.command != "search":
            raise
        items = None  # a search goes on from the index alone
    engine = Engine(store, embedder, items)
    if args.command == "search":
        note = None if args.no_sync_check else engine.sync_note()
        filters = SearchFilters(args.tag, args.creator, args.item_type, args.collection)
        hits = engine.search(args.query, args.limit, filters, overlap_reranker if args.rerank else None)
        return render.json_document(hits, note=note, query=args.query) if args.json else render.search_text(hits, args.query, note)
    if args.command == "find":
        found = engine.find(args.query, everything=args.everything, tag=args.tag, item_type=args.item_type, collection=args.collection, creator=args.creator, sort=args.sort, descending=args.desc, limit=args.limit)
        return render.json_document(found, query=args.query) if args.json else render.find_text(found, args.query)
    if args.command == "get":
        item = engine.get(args.key)
        row = (render.json_rows(item) if args.json else render.item_lines(item)).first()
        if row is None:
            raise LookupError(f"no item {args.key}")
        return json.dumps(json.loads(row.json), indent=2, ensure_ascii=False) if args.json else row.text
    if args.command == "pdf":
        kids = library.children(items).select(F.col("parent_item").alias("item_key"), F.col("item_key").alias("place"), "content_type", file_path_of("path").alias("location"))
        path = catalog.pdf(kids, args.key).first().path
        return json.dumps({"key": args.key, "path": path}, indent=2) if args.json else render.pdf_text(args.key, path)
    if args.command == "fulltext":
        part = engine.fulltext(args.key, start=args.start, end=args.end, max_chars=args.max_chars)
        row = part.first()
        if row is None:
            raise LookupError(f"no full text for {args.key}")
        if row.text is None:
            raise LookupError(f"start is beyond the {row.total_chars} characters of {args.key}")
        return json.dumps(row.asDict(), indent=2, ensure_ascii=False) if args.json else render.fulltext_lines(part).first().text
    if args.command in ("tags", "authors"):
        found = engine.tags(args.contains) if args.command == "tags" else engine.authors(args.contains)
        if args.json:
            return render.json_document(found, args.command)
        lines = [r.text for r in render.tag_lines(found).collect()] if args.command == "tags" else [f"  {r.author}\n" for r in found.collect()]
        return f"{args.command.capitalize()}: {len(lines)}\n\n" + "".join(lines)
    if args.what == "status":
        return json.dumps(engine.status(), indent=2) if args.json else render.status_text(engine.status())
    if args.what == "issues":
        return render.json_document(engine.issues(), "issues") if args.json else render.issues_text(engine.issues())
    files = library.Files(spark, args.files) if args.files else None
    run = build_index(store, items, embedder, files, lambda found: documents.reports(found, pdf.pages), force=args.force)
    if args.json:
        return json.dumps(vars(run), indent=2)
    return f"Done. {run.added} new or changed, {run.deleted} deleted, {run.retried} retried; {run.reindexed} indexed again. {run.item_count} items, {run.chunk_count} chunks."


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(answer(spark, args))
    except Exception as e:  # noqa: BLE001  a command line answers with a message
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
