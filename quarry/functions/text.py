"""Text cleaning as Column expressions: everything here stays in the JVM and inside code generation where Spark allows.

Offsets and lengths are in code points. Patterns keep to what both Java's engine and RE2 understand in the same way, so
that the oracle SQL can use them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode's White_Space property.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The entities that notes and pages decode, in this order but for &amp;, which comes last so that nothing is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
PAGE_ENTITIES = ENTITIES | {"&mdash;": "-"}

NOTE_TAG = r"<[^>]*(?:>|\z)|>"
PAGE_TAG = r"(?is)<script(?:[\s>/].*?(?:</script>|\z)|\z)|<style(?:[\s>/].*?(?:</style>|\z)|\z)|<[^>]*(?:>|\z)"
MAX_STRIP_CHARS = 2 * 1024 * 1024
MAX_FULLTEXT_BYTES = 2 * 1024 * 1024


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def collapse_white(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{WHITE}]+", " "))


def trim_white(c) -> Column:
    return F.regexp_replace(col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def decode_entities(c, entities: dict[str, str] = ENTITIES) -> Column:
    out = col(c)
    for name, value in entities.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def strip_note(c) -> Column:
    """The text of a note's markup: every tag, and a lone '>', becomes a space; an open tag drops the rest."""
    return collapse_white(decode_entities(F.regexp_replace(col(c), NOTE_TAG, " ")))


def strip_page(c) -> Column:
    """The text of a page's markup, without scripts and styles; a lone '>' stays."""
    return collapse_white(decode_entities(F.regexp_replace(col(c), PAGE_TAG, " "), PAGE_ENTITIES))


def strip_and_cap(c, limit: int = MAX_STRIP_CHARS) -> Column:
    return F.substring(strip_page(c), 1, limit)


def clean_text(c) -> Column:
    """Lines trimmed, blank ones dropped, no NULs."""
    lines = F.split(F.replace(col(c), F.lit("\0"), F.lit("")), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, trim_white), lambda x: x != ""), "\n")


def shortened(c, limit: int) -> Column:
    """At most limit characters, with '...' where something was cut."""
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit("..."))).otherwise(col(c))


def cut_bytes(c, limit: int | None = MAX_FULLTEXT_BYTES) -> Column:
    """At most limit bytes of UTF-8, ending with a whole character: an incomplete last one is dropped. None: the whole text."""
    if limit is None:
        return col(c)
    head = F.substring(F.encode(col(c), "UTF-8"), 1, limit)
    # A character has up to four bytes; try_validate finds the longest prefix that is whole.
    prefixes = F.array(*[F.try_validate_utf8(F.substring(head, 1, limit - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(col(c)) <= limit, col(c)).otherwise(F.coalesce(*[prefixes[k] for k in range(4)]))


def display_name(creator: Column) -> Column:
    """Of a struct firstName, lastName, name: the single name if there is one, else 'Last, First' or what there is."""
    first, last = text_or_empty(creator["firstName"]), text_or_empty(creator["lastName"])
    return (
        F.when(creator["name"].isNotNull(), creator["name"])
        .when((last != "") & (first != ""), F.concat(last, F.lit(", "), first))
        .when(last != "", last)
        .otherwise(first)
    )


def creators_string(creators) -> Column:
    """The authors' names, joined by '; '."""
    authors = F.filter(col(creators), lambda c: c["creatorType"] == "author")
    return F.coalesce(F.array_join(F.transform(authors, display_name), "; "), F.lit(""))


def tags_string(tags) -> Column:
    return F.coalesce(F.array_join(col(tags), ", "), F.lit(""))


def split_tags(joined) -> Column:
    return F.filter(F.split(col(joined), ", ", -1), lambda x: x != "")


def metadata_text(title, authors, abstract, tags) -> Column:
    """The non-empty ones of the four, a line each."""
    return F.concat_ws("\n", *[F.nullif(col(c), F.lit("")) for c in (title, authors, abstract, tags)])


def fulltext_slice(c, start=None, end=None, max_chars=None) -> Column:
    """struct<start, end, total_chars, text>: [start, end) clamped to the text, at most max_chars; null where start is beyond it."""
    total = F.length(col(c))
    begin = F.lit(0 if start is None else start)
    stop = total if end is None else F.least(F.lit(end), total)
    if max_chars is not None:
        stop = F.least(stop, begin + F.lit(max_chars))
    stop = F.greatest(stop, begin)
    found = F.struct(begin.alias("start"), stop.alias("end"), total.alias("total_chars"), F.substring(col(c), begin + 1, stop - begin).alias("text"))
    return F.when((begin < total) | ((total == 0) & (begin == 0)), found)


def page_list(pages, shown: int = 8) -> Column:
    """Page numbers, the first eight of them, and how many more there are."""
    p = col(pages)
    head = F.array_join(F.transform(F.slice(p, 1, shown), lambda x: x.cast("string")), ", ")
    return F.when(F.size(p) > shown, F.concat(head, F.lit(", +"), (F.size(p) - shown).cast("string"), F.lit(" more"))).otherwise(head)


def text_hash(c) -> Column:
    """For change detection only: equality is all it's used for."""
    return F.md5(text_or_empty(c))


def tokens(c, long: int = 40) -> Column:
    """The analyser's terms before stemming: lower-cased runs of letters and digits of fewer than `long` bytes."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.octet_length(w) < long)


def cosine(a, b) -> Column:
    """Cosine in double over the common length; 0 where a vector has no length."""
    x, y = F.transform(col(a), lambda v: v.cast("double")), F.transform(col(b), lambda v: v.cast("double"))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, zero)), zero, lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, e: s + e * e))
    return F.when((norm(x) == 0) | (norm(y) == 0), zero).otherwise(dot / (norm(x) * norm(y)))


def file_path_of(location) -> Column:
    """The local path of a file:// address, decoded; null for any other."""
    return F.when(col(location).startswith("file://"), F.try_url_decode(F.regexp_replace(F.regexp_replace(col(location), "^file://", ""), r"\+", "%2B")))
