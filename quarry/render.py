"""Rendering of results: JSON documents, and text for people. Rows are rendered where they are; headings on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import shortened


def json_rows(df: DataFrame) -> DataFrame:
    """(json): one object a row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def json_document(df: DataFrame, name: str = "results", **head) -> str:
    """A pretty-printed document of a short result: heading fields, a count, and the rows."""
    rows = [json.loads(r.json) for r in json_rows(df).collect()]
    count = {"results": "result_count"}.get(name, "count")
    return json.dumps({k: v for k, v in head.items() if v is not None} | {count: len(rows), name: rows}, indent=2, ensure_ascii=False)


def _line(label: str, c, sep: str = "") -> Column:
    """'label value' on a line of its own, or nothing where the value is empty."""
    value = F.array_join(c, sep) if sep else F.col(c)
    return F.when(value != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise(F.lit(""))


def search_lines(hits: DataFrame) -> DataFrame:
    """(score, key, text) of search results, without their places."""
    snippet = F.replace(shortened("snippet", 200), F.lit("\n"), F.lit(" "))
    text = F.concat(
        F.format_string("[%s] %s (score: %.3f)\n   %s | %s | %s\n", "key", "title", "score", "creators", "date", "item_type"),
        F.when(F.col("snippet") != "", F.concat(F.lit("   > "), snippet, F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.col("chunk_type") == "fulltext", F.format_string("   chars %d-%d\n", "char_start", "char_end")).otherwise(F.lit("")),
    )
    return hits.select("score", "key", text.alias("text"))


def find_lines(found: DataFrame) -> DataFrame:
    text = F.concat(F.format_string("[%s] %s\n   %s | %s | %s\n", "key", "title", "creators", "date", "item_type"), _line("   tags: ", "tags", ", "))
    return found.select(text.alias("text"))


def item_lines(item: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("creators", lambda c: c["name"]), "; ")
    text = F.concat(
        F.format_string("[%s] %s\nType: %s\n", "key", "title", "item_type"),
        F.when(F.size("creators") > 0, F.concat(F.lit("Authors: "), names, F.lit("\n"))).otherwise(F.lit("")),
        _line("Date: ", "date"), _line("Publication: ", "publication_title"), _line("DOI: ", "doi"), _line("URL: ", "url"), _line("Tags: ", "tags", ", "),
        F.when(F.col("abstract_note") != "", F.concat(F.lit("\nAbstract:\n"), shortened("abstract_note", 500), F.lit("\n"))).otherwise(F.lit("")),
    )
    return item.select(text.alias("text"))


def fulltext_lines(part: DataFrame) -> DataFrame:
    return part.select(F.format_string("[%s] %s (chars %d-%d of %d)\n\n%s", "key", "title", "start", "end", "total_chars", "text").alias("text"))


def tag_lines(tags: DataFrame) -> DataFrame:
    return tags.select(F.format_string("  %s (%d)\n", "tag", "num_items").alias("text"))


def issue_lines(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat(F.format_string("\n[%s] %s\n  status: %s\n", "key", "title", "status"), _line("  detail: ", "detail")).alias("text"))


def _numbered(rows: list) -> str:
    return "".join(f"\n{i}. {r.text}" for i, r in enumerate(rows, 1))


def search_text(hits: DataFrame, query: str, note: str | None = None) -> str:
    rows = search_lines(hits).orderBy(F.col("score").desc(), "key").collect()
    return (f"{note}\n\n" if note else "") + f'Search: "{query}"\nResults: {len(rows)}\n' + _numbered(rows)


def find_text(found: DataFrame, query: str) -> str:
    rows = find_lines(found).collect()
    return f'Find: "{query}"\nResults: {len(rows)}\n' + _numbered(rows)


def pdf_text(key: str, path: str | None) -> str:
    return path if path else f"No PDF found for item {key}"


def issues_text(issues: DataFrame) -> str:
    rows = issue_lines(issues).collect()
    if not rows:
        return "No extraction issues. Every indexed item has usable fulltext."
    return f"Extraction issues: {len(rows)}\n" + "".join(r.text for r in rows)


def status_text(status: dict) -> str:
    lines = ["Index Status", *(f"  {label}: {status[k]}" for label, k in (("Items", "item_count"), ("Chunks", "chunk_count"), ("Vectors", "vector_count"), ("Items without fulltext", "items_without_fulltext")))]
    if status["status_breakdown"]:
        lines += ["  Extraction status:", *(f"    {label}: {n}" for label, n in status["status_breakdown"])]
    lines += [f"  Model: {status['model_name']} (dim {status['model_dim']})", f"  Last sync: {status['last_sync'] or 'never'}", f"  Data dir: {status['data_dir']}"]
    return "\n".join(lines)
