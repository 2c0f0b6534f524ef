r"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `span` = 10 consecutive words of an item, or all words of a shorter one. Of a window's k-gram hashes, k being
half the span, the smallest is its fingerprint; a document keeps one fingerprint for each run of windows that have the
same smallest hash, about two for seven words. Two texts that share a window share its fingerprint (that is winnowing's
guarantee), so documents and items are joined on fingerprints first. A hit is then extended to the words around it: the
windows of its run, 15 words at most where no gram repeats, travel with the fingerprint and are joined with the items'
windows as whole strings. So hashes decide only what is looked at; what counts as a hit is exact.

A document's words, grams and fingerprints are made within its row; only its fingerprints take part in the first join, and only
those that are an item's go on. That join is a broadcast where Spark finds the items' distinct fingerprints below
its threshold, and a shuffle of fingerprints otherwise. Windows that occur in the same items share the id of that set of items, and
documents with the same sets share one digest of item ids, so that neither copies of an item nor a passage in
very many documents multiplies rows.

Edge cases: null texts and texts without a word have no words and no windows. Items shorter than span get windows and
fingerprints of their own length, made for documents only if there are such items. Each row of documents gives a row,
also where ids or whole rows repeat; items with the same id count as one, those without an id mark words but aren't
listed. Texts are taken whole. Other columns are left out, whatever their names. Without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .pii import let

SPAN = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, only A-Z in lower case."""

    def words(t):
        # lower() would change letters beyond ASCII; translate() is slower.
        low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
        return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))

    return let(F.coalesce(text, F.lit("")), words)


def rolled(values: Column, count: int, merge, overlap: bool = False) -> Column:
    """merge over each `count` neighbours, by doubling; the last count - 1 values are of fewer. overlap: merging a value twice is harmless."""

    def joined(left, right, by: int):
        return F.zip_with(left, F.slice(right, F.lit(by + 1), F.size(right)), merge)

    def grown(value, width: int, rest: Column | None, done: int):
        """rest: merged over `done` neighbours that follow those of value."""
        if 2 * width <= count:
            return let(joined(value, value, width), lambda x: grown(x, 2 * width, rest, done))
        if width == count:
            return value
        return joined(value, value, count - width)

    if overlap:
        return grown(values, 1, None, 0)
    # Not idempotent: the widths of count's binary digits stand side by side, the widest first.
    widths = [1 << b for b in reversed(range(count.bit_length())) if count >> b & 1]

    def powers(value, width: int, known: dict[int, Column]):
        known = {**known, width: value}
        if width < widths[0]:
            return let(joined(value, value, width), lambda x: powers(x, 2 * width, known))
        out, done = known[widths[0]], widths[0]
        for w in widths[1:]:
            out, done = joined(out, known[w], done), done + w
        return out

    return powers(values, 1, {})


def smallest(words: Column, span: int) -> Column:
    """For each window of span words the smallest hash of its grams; empty for fewer words."""
    k = (span + 1) // 2
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: rolled(h, k, lambda a, b: F.xxhash64(a, b)))
    windows = let(grams, lambda g: rolled(g, span - k + 1, lambda a, b: F.least(a, b), overlap=True))
    return F.slice(windows, F.lit(1), F.greatest(F.size(words) - (span - 1), F.lit(0)))


def windows_of(words: Column, span: int) -> Column:
    """array<struct<print, text>>: all windows of an item."""
    return let(smallest(words, span), lambda m: F.transform(m, lambda p, i: F.struct(p.alias("print"), F.array_join(F.slice(words, i + 1, F.lit(span)), " ").alias("text"))))


def fingerprints(words: Column, span: int) -> Column:
    """array<struct<print, at, span, n, own>>: for each run of windows with one smallest hash, where it begins and its words."""

    def runs(m):
        count = F.size(m)
        begins = F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (m[i] != m[i - 1]))

        def one(i, following):
            own = F.slice(words, i + 1, F.coalesce(following, count) - i + (span - 1))
            return F.struct(m[i].alias("print"), i.alias("at"), F.lit(span).alias("span"), F.size(words).alias("n"), own.alias("own"))

        return F.when(count > 0, let(begins, lambda b: F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), one)))

    return let(smallest(words, span), runs)


def item_windows(items: DataFrame, item_id: str, text: str, span: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(text, print, set_id) of the items' distinct windows, (set_id, items) of the sets of items they occur in, and the windows' lengths."""
    rows = fresh(items, item_id, text).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = stored(rows.withColumn("span", F.least(F.size("words"), F.lit(span))), "items")
    spans = sorted(r.span for r in rows.select("span").distinct().collect())  # span lengths at most
    windows = None
    for s in spans:
        own = rows.where(F.col("span") == s).select("item", F.explode(windows_of(F.col("words"), s)).alias("w")).select("item", "w.print", "w.text")
        windows = own if windows is None else windows.unionByName(own)
    if windows is None:
        windows = rows.select("item", F.lit(0).cast("long").alias("print"), F.lit("").alias("text")).limit(0)
    grouped = stored(windows.groupBy("text").agg(F.first("print").alias("print"), F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sets = stored(grouped.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()), "sets")
    return stored(grouped.join(sets, "items").select("text", "print", "set_id"), "windows"), sets, spans


def covered(spans: Column) -> Column:
    """How many places sorted spans (struct<at, upto>) cover."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))

    def step(acc, s):
        more = F.greatest(s["upto"] - F.greatest(s["at"], acc["upto"]), F.lit(0))
        return F.struct((acc["total"] + more).alias("total"), F.greatest(acc["upto"], s["upto"]).alias("upto"))

    return F.aggregate(spans, start, step, lambda acc: acc["total"])


def hits(documents: DataFrame, windows: DataFrame, spans: list[int], doc_id: str, text: str) -> DataFrame:
    """(row, id, n, at, span, set_id): each occurrence of a window in a document, and a row with span 0 for each document."""
    prints = windows.select("print").distinct().withColumn("known", F.lit(True))

    def made(words):
        none = F.struct(F.lit(None).cast("long").alias("print"), F.lit(0).alias("at"), F.lit(0).alias("span"), F.size(words).alias("n"), F.expr("cast(array() as array<string>)").alias("own"))
        empty = F.expr("cast(array() as array<struct<print: bigint, at: int, span: int, n: int, own: array<string>>>)")
        return F.concat(F.array(none), *[F.coalesce(fingerprints(words, s), empty) for s in spans])

    rows = fresh(documents, doc_id, text).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), let(words_of(F.col(text)), made).alias("made"))
    rows = rows.select("row", "id", F.explode("made").alias("p"))  # in a step of its own, or rows would be numbered after it
    # The row that stands for a document meets no fingerprint; its key differs from row to row, so that a shuffle spreads it.
    rows = rows.select("row", "id", "p.*").withColumn("print", F.coalesce("print", "row"))
    rows = rows.join(prints, "print", "left").where(F.col("known") | (F.col("span") == 0)).drop("print", "known")
    places = F.when(F.col("span") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("own") - F.col("span")))
    each = rows.withColumn("by", F.explode(places))
    key = F.when(F.col("span") == 0, F.concat(F.lit(" "), F.col("row").cast("string"))).otherwise(F.array_join(F.slice("own", F.col("by") + 1, F.col("span")), " "))
    each = each.select("row", "id", "n", (F.col("at") + F.col("by")).alias("at"), "span", key.alias("text"))
    found = each.join(windows.select("text", "set_id"), "text", "left").where((F.col("span") == 0) | F.col("set_id").isNotNull())
    return stored(found.select("row", "id", "n", "at", "span", "set_id"), "hits")


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>-digest columns n_items and items_sha256, contaminated) of each document."""
    windows, sets, spans = item_windows(items, item_id, text, span)
    found = hits(documents, windows, spans, doc_id, text)
    # A document's own windows: as many as it has words, for each length of windows.
    own = F.when(F.col("span") > 0, F.struct("at", (F.col("at") + F.col("span")).alias("upto")))
    rows = found.groupBy("row", "id", "n").agg(F.collect_set(own).alias("spans"), F.array_sort(F.collect_set("set_id")).alias("sets"))
    rows = stored(rows.select("id", "n", covered(F.array_sort("spans")).alias("n_hit"), "sets"), "rows")
    lists = rows.select("sets").where(F.size("sets") > 0).distinct()
    ids = lists.select("sets", F.explode("sets").alias("set_id")).join(sets, "set_id").groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    digests = ids.select("sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = rows.where(F.size("sets") > 0).join(digests, "sets").drop("sets")
    clean = rows.where(F.size("sets") == 0).select("id", "n", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    return hit.unionByName(clean).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_words"), "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
