"""DuckDB SQL with the same rows as the queries of core_queries, written against the tables and not from the Spark plans."""

from __future__ import annotations

import hashlib

from .core_queries import CHUNKS, DIM, DOCS, POSTINGS, TERMS, TOKENS, _bm25_sql
from .functions.text import NOTE_TAG, PAGE_TAG, WHITE

_B = _bm25_sql(TERMS.split())
_BM = f"WITH {CHUNKS}, {TOKENS}, {POSTINGS}, {_B}"
_ROUNDED = "SELECT chunk_id, round(score, 6) AS score FROM scored"


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WHITE}]+', ' ', 'g'), ' ')"


def _entities(x: str, page: bool) -> str:
    table = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")] + [("&mdash;", "-")] * page + [("&amp;", "&")]
    for a, b in table:
        x = f"replace({x}, '{_sql(a)}', '{_sql(b)}')"
    return x


_PAGE = _collapse(_entities(f"regexp_replace(html, '{_sql(PAGE_TAG)}', ' ', 'g')", True))
_NOTE = _collapse(_entities(f"regexp_replace(note, '{_sql(NOTE_TAG)}', ' ', 'g')", False))

_COUNTS = [0.0] * DIM
for _w in TERMS.split():
    _COUNTS[int(hashlib.md5(_w.encode()).hexdigest()[:8], 16) % DIM] += 1.0
_DENSE = f"""words AS (SELECT chunk_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS b
  FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM chunks)),
bins AS (SELECT chunk_id, b, count(*) AS n FROM words GROUP BY 1, 2), q AS (SELECT unnest({_COUNTS}) AS qn, unnest(range({DIM})) AS b),
norms AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM bins GROUP BY 1),
cosines AS (SELECT chunk_id, round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(qn * qn)) FROM q)), 6) AS score FROM norms
  LEFT JOIN (SELECT chunk_id, sum(n * qn) AS dot FROM bins JOIN q USING (b) GROUP BY 1) USING (chunk_id)),
dense AS (SELECT chunk_id, coalesce(score, 0.0) AS score FROM chunks LEFT JOIN cosines USING (chunk_id))"""


def _lists(where: str = "true") -> str:
    ok = f"SELECT chunk_id FROM chunks WHERE {where}"
    return f"""{_BM}, {_DENSE},
a AS (SELECT chunk_id, round(score, 6) AS score FROM scored WHERE chunk_id IN ({ok}) ORDER BY 2 DESC, 1 LIMIT 50),
b AS (SELECT chunk_id, score FROM dense WHERE chunk_id IN ({ok}) ORDER BY 2 DESC, 1 LIMIT 50),
ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM a UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) FROM b),
fused AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM ranked GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"""


def _items_of(hits: str, score: str = "score") -> str:
    return f"""SELECT item_key, chunk_id, score, char_start, char_end FROM (SELECT c.item_key, c.chunk_id, {score} AS score, char_start, char_end,
  row_number() OVER (PARTITION BY c.item_key ORDER BY {score} DESC, c.chunk_id) AS n FROM {hits} h JOIN chunks c USING (chunk_id)) WHERE n = 1 ORDER BY score DESC, item_key LIMIT 10"""


_REMOTE = f"""WITH {DOCS}, remote AS (SELECT item_key, CASE WHEN doc_id % 7 = 0 THEN version + 1 ELSE version END AS version FROM items WHERE doc_id % 11 <> 0),
local AS (SELECT item_key, version FROM items WHERE doc_id % 13 <> 0),
diff AS (SELECT item_key, 'add' AS action FROM remote WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.item_key = remote.item_key AND l.version = remote.version)
  UNION ALL SELECT item_key, 'delete' FROM local WHERE item_key NOT IN (SELECT item_key FROM remote)),
status AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS item_key, CASE WHEN doc_id % 10 = 0 THEN 'no-attachment' WHEN quality = 1 AND toxic = 0 THEN 'ok' WHEN quality = 1 THEN 'partial'
  WHEN toxic = 1 THEN 'suspicious' ELSE 'failed' END AS status, 'detail ' || doc_id AS detail, CASE WHEN doc_id % 20 = 0 THEN 2 ELSE 0 END AS status_version FROM labels),
metas AS (SELECT item_key, title, CASE WHEN length(fulltext) >= 500 THEN fulltext ELSE '' END AS fulltext FROM items WHERE doc_id % 2 = 0),
every AS (SELECT item_key, title, CASE WHEN length(fulltext) >= 500 THEN fulltext ELSE '' END AS fulltext FROM items)"""
_STALE = "SELECT item_key FROM status WHERE status = 'no-attachment' AND status_version < 2"
_UNTRACKED = "SELECT item_key FROM metas WHERE fulltext = '' AND item_key NOT IN (SELECT item_key FROM status)"
_UNCHUNKED = "SELECT item_key FROM local WHERE item_key NOT IN (SELECT item_key FROM metas)"

_PEOPLE = """WITH people AS (SELECT c_custkey // 30 AS item, 'author' AS role, c_name AS name FROM customer
  UNION ALL SELECT s_suppkey // 30, 'editor', CASE WHEN s_suppkey % 20 = 0 THEN '' WHEN s_suppkey % 4 = 0 THEN 'Ltd ' || s_nationkey WHEN s_suppkey % 5 = 0 THEN s_name
    ELSE 'Ltd ' || s_nationkey || ', ' || s_name END FROM supplier)"""
_LIBRARY = """WITH lib AS (SELECT conv_id || '-' || turn AS item_key, CASE WHEN turn % 3 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS parent, turn AS place,
  CASE WHEN role = 'user' THEN 'note' WHEN turn % 2 = 0 THEN 'annotation' ELSE 'attachment' END AS t,
  CASE turn % 4 WHEN 1 THEN 'application/pdf' WHEN 3 THEN 'text/html' ELSE '' END AS ct,
  CASE WHEN turn % 5 <> 0 THEN '/data/a b/' || conv_id || '/' || turn END AS location FROM conversations)"""
_COSINE = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[]))"

ORACLES = {
    "chunk_documents": f"WITH {CHUNKS} SELECT chunk_id, item_key, chunk_type, i, char_start, char_end, text FROM chunks",
    "chunk_stats": f"WITH {CHUNKS} SELECT item_type, count(*) AS chunks, count(DISTINCT item_key) AS n_items, max(char_end) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY 1",
    "metadata_chunks": f"WITH {DOCS} SELECT item_key || '_meta' AS chunk_id, item_key, 'metadata' AS chunk_type, title || chr(10) || creators || chr(10) || array_to_string(tags, ', ') AS text FROM items",
    "prefix_ownership": f"WITH {CHUNKS} SELECT item_key, count(*) AS owned FROM chunks WHERE chunk_id = item_key OR starts_with(chunk_id, item_key || '_') GROUP BY 1",
    "html_strip": f"SELECT page_id, {_PAGE} AS body FROM pages",
    "html_outcome_fallback": f"""WITH s AS (SELECT page_id, html, {_PAGE} AS t FROM pages) SELECT page_id, CASE WHEN length(t) < 250 THEN 'suspicious' ELSE 'ok' END AS status,
      CASE WHEN length(t) < 250 THEN 'html snapshot: low text volume (' || length(t) || ' chars, fallback strip)' ELSE 'html snapshot: extracted (fallback strip)' END AS detail, md5(t) AS text_md5 FROM s""",
    "note_strip": f"""WITH n AS (SELECT conv_id, turn, '<p><b>' || role || '</b> &amp; &lt;said&gt;&nbsp;> ' || text || '</p><div' AS note FROM conversations), s AS (SELECT conv_id, turn, {_NOTE} AS t FROM n)
      SELECT conv_id, turn, CASE WHEN t = '' THEN 'no-attachment' ELSE 'ok' END AS status, CASE WHEN t = '' THEN 'empty note' ELSE 'note content' END AS detail, t AS note_text FROM s""",
    "clean_text": f"""SELECT doc_id, md5(array_to_string([y FOR y IN [regexp_replace(x, '^[{WHITE}]+|[{WHITE}]+$', '', 'g') FOR x IN string_split(chr(10) || '  ' || replace(text, ' ', ' ' || chr(10) || chr(9)) || chr(10) || chr(10), chr(10))]
      IF y <> ''], chr(10))) AS cleaned_md5 FROM documents""",
    "pdf_outcome": """WITH o AS (SELECT l_orderkey, max(l_linenumber) + 10 AS pages, coalesce(list(l_linenumber) FILTER (l_returnflag = 'R'), []) AS b, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1),
      r AS (SELECT *, list_sort(list_concat(b, [p + 10 FOR p IN b])) AS bad FROM o),
      x AS (SELECT *, len(bad) AS nb, greatest(pages - len(bad), 0) AS good, 5 * q AS chars FROM r),
      y AS (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN 0 WHEN q = 0 OR good = 0 THEN 1 WHEN nb > 0 THEN 2 WHEN pages > 2 AND chars < 200 * pages THEN 3 ELSE 4 END AS k FROM x)
      SELECT l_orderkey, ['failed', 'failed', 'partial', 'suspicious', 'ok'][k + 1] AS status, CASE k WHEN 0 THEN 'malformed PDF: no trailer'
        WHEN 1 THEN 'malformed PDF: ' || CASE WHEN nb = 0 THEN 'no extractable text' ELSE 'all ' || pages || ' pages failed to extract' END
        WHEN 2 THEN 'extracted ' || good || '/' || pages || ' pages (failed: ' || array_to_string(bad[1:8], ', ') || CASE WHEN nb > 8 THEN ', +' || (nb - 8) || ' more' ELSE '' END || ')'
        WHEN 3 THEN 'low text volume: ' || chars || ' chars over ' || pages || ' pages (~' || (chars // greatest(pages, 1)) || '/page)' ELSE '' END AS detail,
        CAST(CASE WHEN k < 2 THEN 0 ELSE chars END AS INTEGER) AS chars FROM y""",
    "tokenize_stats": r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms
      FROM (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[\p{L}\p{N}]+') IF strlen(w) < 40] AS t FROM documents)""",
    "postings": f"WITH {CHUNKS}, {TOKENS}, {POSTINGS} SELECT term, chunk_id, tf, len FROM post JOIN lens USING (chunk_id)",
    "doc_frequency": f"WITH {CHUNKS}, {TOKENS}, {POSTINGS} SELECT term, count(*) AS df FROM post GROUP BY 1",
    "bm25_top": f"{_BM} {_ROUNDED} ORDER BY 2 DESC, 1 LIMIT 50",
    "bm25_filtered": f"{_BM} {_ROUNDED} WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE source = 'src3' AND item_type = 'en') ORDER BY 2 DESC, 1 LIMIT 20",
    "bm25_per_item": f"""{_BM} SELECT item_key, chunk_id, score FROM (SELECT item_key, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_key ORDER BY round(score, 6) DESC, chunk_id) AS n
      FROM scored JOIN chunks USING (chunk_id)) WHERE n = 1 ORDER BY score DESC, item_key LIMIT 20""",
    "bm25_multi_field": rf"""WITH {CHUNKS}, f AS (SELECT chunk_id, 'text' AS field, text AS t FROM chunks UNION ALL SELECT chunk_id, 'title', title FROM chunks UNION ALL SELECT chunk_id, 'creators', creators FROM chunks),
      toks AS (SELECT chunk_id, field, [z FOR z IN regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') IF strlen(z) < 40] AS w FROM f),
      stats AS (SELECT field, count(*) AS n, avg(len(w)) AS avg_len FROM toks GROUP BY 1),
      post AS (SELECT chunk_id, field, term, len(w) AS len, len([x FOR x IN w IF x = term]) AS tf FROM toks, (SELECT unnest(['src3', 'document', 'the']) AS term)),
      dfs AS (SELECT field, term, count(*) AS df FROM post WHERE tf > 0 GROUP BY 1, 2)
      SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
      FROM post JOIN dfs USING (field, term) JOIN stats USING (field) WHERE tf > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "bm25_grammar": rf"""WITH {CHUNKS}, f AS (SELECT chunk_id, 'text' AS field, text AS t FROM chunks UNION ALL SELECT chunk_id, 'title', title FROM chunks UNION ALL SELECT chunk_id, 'creators', creators FROM chunks),
      toks AS (SELECT chunk_id, field, [z FOR z IN regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') IF strlen(z) < 40] AS w FROM f),
      stats AS (SELECT field, count(*) AS n, avg(len(w)) AS avg_len FROM toks GROUP BY 1),
      want AS (SELECT * FROM (VALUES ('the', 1.0), ('of', 1.0), ('and', 1.0), ('src3', 2.0)) v(term, boost)),
      post AS (SELECT chunk_id, field, term, boost, len(w) AS len, len([x FOR x IN w IF x = term]) AS tf FROM toks, want WHERE term <> 'src3' OR field = 'creators'),
      dfs AS (SELECT field, term, count(*) AS df FROM post WHERE tf > 0 GROUP BY 1, 2),
      s AS (SELECT chunk_id, term, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s FROM post JOIN dfs USING (field, term) JOIN stats USING (field) WHERE tf > 0)
      SELECT chunk_id, round(sum(s), 6) AS score FROM s WHERE chunk_id IN (SELECT chunk_id FROM s WHERE term = 'the') AND chunk_id NOT IN (SELECT chunk_id FROM toks WHERE list_contains(w, 'que'))
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "phrase_query": rf"""WITH {CHUNKS}, toks AS (SELECT chunk_id, [z FOR z IN regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') IF strlen(z) < 40] AS w FROM chunks),
      k AS (SELECT count(*) AS n, avg(len(w)) AS avg_len, count(*) FILTER (list_contains(w, 'of')) AS d1, count(*) FILTER (list_contains(w, 'the')) AS d2 FROM toks),
      p AS (SELECT chunk_id, len(w) AS len, len([i FOR i IN range(1, len(w)) IF w[i] = 'of' AND w[i + 1] = 'the']) AS tf FROM toks)
      SELECT chunk_id, round((ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM p, k WHERE tf > 0""",
    "cosine_top": f"SELECT v.vec_id, round({_COSINE}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 0) w ORDER BY {_COSINE} DESC, 1 LIMIT 20",
    "cosine_filtered": f"SELECT v.vec_id, round({_COSINE}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 0) w WHERE v.label = 3 ORDER BY {_COSINE} DESC, 1 LIMIT 10",
    "cosine_many": f"""SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT w.vec_id AS query_id, v.vec_id, {_COSINE} AS s, row_number() OVER (PARTITION BY w.vec_id ORDER BY {_COSINE} DESC, v.vec_id) AS n
      FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) w) WHERE n <= 5""",
    "rrf_fusion": f"{_lists()} SELECT chunk_id, score FROM fused",
    "hybrid_search": f"{_lists()} {_items_of('fused')}",
    "hybrid_filtered": _lists("item_type = 'en' AND source = 'src3'") + " " + _items_of("fused"),
    "hybrid_reranked": rf"""{_lists()}, re AS (SELECT chunk_id, len(list_intersect(list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') IF strlen(w) < 40]), {TERMS.split()})) / 3.0::DOUBLE AS score
      FROM fused f JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT 10) {_items_of('re', 'h.score')}""",
    "sync_diff": f"{_REMOTE} SELECT * FROM diff",
    "sync_counts": f"{_REMOTE} SELECT action, count(*) AS n FROM diff GROUP BY 1",
    "retry_keys": f"""{_REMOTE} SELECT item_key FROM (SELECT item_key FROM status WHERE status IN ('failed', 'partial', 'suspicious') UNION {_UNTRACKED} UNION {_UNCHUNKED} UNION {_STALE})
      WHERE item_key IN (SELECT item_key FROM remote) AND item_key NOT IN (SELECT item_key FROM diff WHERE action = 'add')""",
    "stale_no_attachment": f"{_REMOTE} {_STALE}",
    "untracked_keys": f"{_REMOTE} {_UNTRACKED}",
    "unchunked_keys": f"{_REMOTE} {_UNCHUNKED}",
    "rebuild_versions": f"""{_REMOTE}, done AS (SELECT * FROM remote WHERE CAST(item_key AS BIGINT) % 3 = 0)
      SELECT item_key, version FROM done UNION ALL SELECT item_key, version FROM local WHERE item_key IN (SELECT item_key FROM remote) AND item_key NOT IN (SELECT item_key FROM done)""",
    "run_plan": f"""{_REMOTE}, keys AS (SELECT item_key FROM remote UNION SELECT item_key FROM local UNION SELECT item_key FROM status UNION SELECT item_key FROM metas),
      why AS (SELECT item_key, 1 AS n, 'outcome' AS reason FROM status WHERE status IN ('failed', 'partial', 'suspicious') UNION ALL SELECT item_key, 2, 'untracked' FROM ({_UNTRACKED})
        UNION ALL SELECT item_key, 3, 'unchunked' FROM ({_UNCHUNKED}) UNION ALL SELECT item_key, 4, 'stale' FROM ({_STALE})),
      first AS (SELECT item_key, arg_min(reason, n) AS reason FROM why GROUP BY 1),
      s AS (SELECT item_key, d.action, CASE WHEN r.item_key IS NOT NULL AND d.action IS NULL THEN f.reason END AS reason, r.version AS r, l.version AS l, coalesce(m.fulltext, '') <> '' AS has_text
        FROM keys LEFT JOIN diff d USING (item_key) LEFT JOIN first f USING (item_key) LEFT JOIN remote r USING (item_key) LEFT JOIN local l USING (item_key) LEFT JOIN metas m USING (item_key))
      SELECT item_key, action, reason, r IS NOT NULL AND (action IS NOT NULL OR reason IS NOT NULL) AS queued, has_text,
        CASE WHEN r IS NOT NULL THEN CASE WHEN action IS NOT NULL OR reason IS NOT NULL THEN r ELSE l END END AS next_version FROM s""",
    "upsert_chunks": f"""WITH {CHUNKS}, up AS (SELECT item_key, ('x' || fulltext) AS u, unnest(range(CAST(CASE WHEN length(fulltext) + 1 <= 1000 THEN 1 ELSE 1 + ceil((length(fulltext) - 999) / 1000.0) END AS BIGINT))) AS i FROM items WHERE doc_id % 5 = 0)
      SELECT chunk_id, item_key, md5(text) AS text_md5 FROM chunks WHERE CAST(item_key AS BIGINT) % 5 <> 0 UNION ALL SELECT item_key || '_' || i, item_key, md5(substring(u, CAST(i * 1000 + 1 AS BIGINT), 1000)) FROM up""",
    "delete_items": f"WITH {CHUNKS} SELECT chunk_id, item_key FROM chunks WHERE CAST(item_key AS BIGINT) % 11 <> 0",
    "change_hash": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents",
    "status_breakdown": f"""{_REMOTE} SELECT status, count(*) AS count FROM status GROUP BY 1 UNION ALL
      SELECT 'unknown', n FROM (SELECT (SELECT count(*) FROM items) - (SELECT count(*) FROM status) AS n) WHERE n > 0""",
    "issues_list": f"{_REMOTE} SELECT s.item_key AS key, coalesce(m.title, '') AS title, status, detail FROM status s LEFT JOIN every m USING (item_key) WHERE status <> 'ok'",
    "items_without_fulltext": f"{_REMOTE} SELECT item_key, title FROM every WHERE fulltext = ''",
    "index_counts": f"""WITH {CHUNKS} SELECT (SELECT count(*) FROM items) AS item_count, (SELECT count(*) FROM items) + (SELECT count(*) FROM chunks) AS chunk_count,
      CAST((SELECT sum(length(text)) FROM chunks) + (SELECT sum(length(title || chr(10) || creators || chr(10) || array_to_string(tags, ', '))) FROM items) AS BIGINT) AS chars""",
    "tags_list": f"WITH {DOCS} SELECT tag, count(DISTINCT item_key) AS num_items FROM (SELECT item_key, unnest(tags) AS tag FROM items) GROUP BY 1",
    "tags_contains": f"WITH {DOCS} SELECT tag, count(DISTINCT item_key) AS num_items FROM (SELECT item_key, unnest(tags) AS tag FROM items) WHERE contains(lower(tag), 'src1') GROUP BY 1",
    "authors_list": f"{_PEOPLE} SELECT DISTINCT name AS author FROM people WHERE name <> ''",
    "authors_contains": f"{_PEOPLE} SELECT DISTINCT name AS author FROM people WHERE contains(lower(name), 'ltd 1')",
    "creators_strings": f"{_PEOPLE} SELECT item, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (role = 'author'), '') AS authors FROM people GROUP BY 1",
    "item_predicates": f"""{_LIBRARY} SELECT item_key, t NOT IN ('attachment', 'note', 'annotation') AS regular, t = 'attachment' AND parent = '' AS attachment, t = 'attachment' AND parent = '' AND ct = 'application/pdf' AS pdf,
      t = 'attachment' AND parent = '' AND ct = 'text/html' AS html, t = 'note' AND parent = '' AS note, t IN ('attachment', 'note') AND parent = '' AS indexable FROM lib""",
    "child_pick": f"""{_LIBRARY} SELECT item_key, place, content_type, location FROM (SELECT parent AS item_key, place, ct AS content_type, location,
      row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN ct = 'application/pdf' THEN 0 ELSE 1 END, place) AS n FROM lib
      WHERE parent <> '' AND location IS NOT NULL AND (ct = 'text/html' OR ct = 'application/pdf' AND place % 2 = 1)) WHERE n = 1""",
    "pdf_paths": f"""{_LIBRARY} SELECT item_key, location FROM (SELECT parent AS item_key, location, row_number() OVER (PARTITION BY parent ORDER BY place) AS n FROM lib
      WHERE parent <> '' AND location IS NOT NULL AND ct = 'application/pdf') WHERE n = 1""",
    "find_items": f"""WITH {DOCS} SELECT item_key AS key, title, item_type, creators FROM items WHERE list_contains(tags, 'en') AND contains(lower(title || chr(10) || creators), 'document')
      AND contains(lower(title || chr(10) || creators), '1') AND contains(lower(title || chr(10) || creators), 'src1') ORDER BY title DESC, item_key LIMIT 25""",
    "get_item": f"WITH {DOCS} SELECT item_key AS key, title, creators, item_type, array_to_string(tags, ', ') AS tags FROM items WHERE doc_id = 42",
    "fulltext_slice": """SELECT doc_id, CAST(100 AS INTEGER) AS start, CAST(least(900, length(text), 600) AS INTEGER) AS "end", CAST(length(text) AS INTEGER) AS total_chars,
      substring(text, 101, least(900, length(text), 600) - 100) AS part FROM documents WHERE length(text) > 100""",
    "shortened": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet FROM documents",
}
ORACLES["grammar_constructs"] = rf"""WITH {CHUNKS}, f AS (SELECT chunk_id, 'text' AS field, text AS t FROM chunks UNION ALL SELECT chunk_id, 'title', title FROM chunks UNION ALL SELECT chunk_id, 'creators', creators FROM chunks),
  toks AS (SELECT chunk_id, field, [z FOR z IN regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') IF strlen(z) < 40] AS w FROM f),
  k AS (SELECT count(*) AS n, avg(len(w)) AS avg_len, count(*) FILTER (list_contains(w, 'of')) AS d1, count(*) FILTER (list_contains(w, 'the')) AS d2 FROM toks WHERE field = 'text'),
  p AS (SELECT chunk_id, len(w) AS len, len([i FOR i IN range(1, len(w)) IF w[i] = 'of' AND len([j FOR j IN range(i + 1, i + 4) IF j <= len(w) AND w[j] = 'the']) > 0]) AS tf FROM toks WHERE field = 'text'),
  g AS (SELECT chunk_id, CAST(bool_or(field = 'text' AND len([x FOR x IN w IF x >= 'que' AND x < 'quf']) > 0) AS INTEGER) AS a, CAST(bool_or(list_contains(w, 'der') OR list_contains(w, 'und')) AS INTEGER) AS b,
    CAST(bool_or(field = 'creators' AND len([x FOR x IN w IF starts_with(x, 'src1')]) > 0) AS INTEGER) AS c FROM toks GROUP BY 1)
  SELECT chunk_id, round((ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) + a + b + 2 * c, 6) AS score
  FROM p JOIN g USING (chunk_id), k WHERE tf > 0"""

_WORKS = """works AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS item_key, text, CASE WHEN quality IS NULL THEN CASE WHEN lang = 'fr' THEN 'lost' ELSE 'same' END
  WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'mended' ELSE 'broken' END WHEN quality = 1 THEN 'changed' ELSE 'gone' END AS kind FROM documents LEFT JOIN labels USING (doc_id))"""
ORACLES["index_run"] = f"""WITH {_WORKS}, held AS (SELECT *, CASE kind WHEN 'broken' THEN '' WHEN 'changed' THEN 'x ' || text ELSE text END AS t FROM works WHERE kind <> 'gone')
  SELECT item_key, CASE WHEN kind IN ('broken', 'lost') THEN 'failed' ELSE 'ok' END AS status, CASE WHEN kind IN ('broken', 'lost') THEN 'malformed PDF: no trailer' ELSE '' END AS detail,
    CAST(CASE WHEN kind IN ('changed', 'lost') THEN 2 ELSE 1 END AS BIGINT) AS version, 1 + CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1500 THEN 1 ELSE 1 + CAST(ceil((length(t) - 1500) / 1300.0) AS BIGINT) END AS chunks,
    md5(t) AS text_md5 FROM held"""

_INDEXED = rf"""WITH {CHUNKS}, every AS (SELECT chunk_id, item_key, chunk_type, char_start, char_end, text, title, creators, item_type FROM chunks
  UNION ALL SELECT item_key || '_meta', item_key, 'metadata', 0, 0, title || chr(10) || creators || chr(10) || array_to_string(tags, ', '), title, creators, item_type FROM items),
f AS (SELECT chunk_id, 'text' AS field, text AS t FROM every UNION ALL SELECT chunk_id, 'title', title FROM every UNION ALL SELECT chunk_id, 'creators', creators FROM every),
toks AS (SELECT chunk_id, field, [z FOR z IN regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') IF strlen(z) < 40] AS w FROM f),
stats AS (SELECT field, count(*) AS n, avg(len(w)) AS avg_len FROM toks GROUP BY 1),
post AS (SELECT chunk_id, field, term, len(w) AS len, len([x FOR x IN w IF x = term]) AS tf FROM toks, (SELECT unnest({TERMS.split()}) AS term)),
dfs AS (SELECT field, term, count(*) AS df FROM post WHERE tf > 0 GROUP BY 1, 2),
a AS (SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM post JOIN dfs USING (field, term) JOIN stats USING (field) WHERE tf > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
bins AS (SELECT chunk_id, b, count(*) AS n FROM (SELECT chunk_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS b
  FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM every)) GROUP BY 1, 2), q AS (SELECT unnest({_COUNTS}) AS qn, unnest(range({DIM})) AS b),
b AS (SELECT chunk_id, round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(qn * qn)) FROM q)), 9) AS score FROM (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM bins GROUP BY 1)
  LEFT JOIN (SELECT chunk_id, sum(n * qn) AS dot FROM bins JOIN q USING (b) GROUP BY 1) USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT 50),
ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM a UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) FROM b),
fused AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM ranked GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"""
ORACLES["engine_search"] = f"""{_INDEXED} SELECT item_key AS key, title, creators, item_type, round(score, 9) AS score, char_start, char_end, chunk_type FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, chunk_id) AS k FROM fused JOIN every USING (chunk_id)) WHERE k = 1 ORDER BY score DESC, key LIMIT 10"""
# The same rows by another way.
ORACLES["stored_snapshot"] = ORACLES["upsert_chunks"]
ORACLES["tags_ranked"] = f"SELECT *, row_number() OVER (ORDER BY lower(tag), tag) AS rank FROM ({ORACLES['tags_list']})"
ORACLES["issues_ranked"] = f"""SELECT row_number() OVER (ORDER BY list_position(['failed', 'partial', 'suspicious', 'no-attachment'], status), key) AS rank, key, status
  FROM ({ORACLES["issues_list"]})"""
