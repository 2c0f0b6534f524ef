"""One query for each operation, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, embeddedup, langid, lexsearch, lm, merkle, packing, pii, quality, simhash, tokenfile, tokens, topk, winnow
from .common import crc_bucket, scratch

#: Orders above are tested, but need more disk than the check tool allows (README).
LM_ORDER = 2


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, pattern).select(
        "doc_id",
        bpe.id_count().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_langid(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_part(docs))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(simhash.fingerprints(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op4_pii(spark, sf_dir):
    found = pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", pii.is_kind(no))).cast("long").alias(f"n_{kind}") for no, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.rendered(F.col("base")), 256).alias("base_sha256"), pii.rendered(F.col("spans")).alias("spans"))


def op5_embeddings(spark, sf_dir):
    return embeddedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def section(source, lang):
    """The path of a document that has no address: the section of its host that is in its language."""
    return F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(lang, F.lit("")))


def op6_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = quality.classify(docs, _read(spark, sf_dir, "labels"), "source", section(F.col("source"), F.col("lang")), keep_text=False)
    return scored.select("doc_id", "source", "evidence", "host_rate", "path_rate", "quality", "keep")


def op7_packing(spark, sf_dir):
    found = packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    found = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(found)


def op8_lm(spark, sf_dir):
    return lm.score(_read(spark, sf_dir, "documents"), order=LM_ORDER)


def op9_topk(spark, sf_dir):
    rows = topk.quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.where("id % 20 = 0"), rows, k=20)


def op10_tokenfile(spark, sf_dir):
    path = scratch(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write(_read(spark, sf_dir, "documents"), path, vocabulary, tokens.pattern_of(vocabulary))
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_search(spark, sf_dir):
    return lexsearch.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=20)


def op12_winnowing(spark, sf_dir):
    return winnow.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(docs):
    """The leaf of a document whose lines have been joined, for those whose id's crc32 is even; null for all others."""
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    hit = F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    return F.when(hit, merkle.leaf(*[changed if c == "text" else F.col(c) for c in MANIFEST]))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(_read(spark, sf_dir, "documents"), "source", "doc_id", MANIFEST, tampered)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, r.e)]) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e)
  WHERE q.vec_id % 20 = 0
), t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents
), docs AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
stats AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS words FROM docs),
q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
  ) GROUP BY ALL
), post AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), stats
), impact AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // words))) AS v
  FROM post JOIN docs USING (r) JOIN w USING (term), stats
), s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS s FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS t FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM b)
), occurring AS (
  SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS t FROM (
    SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM b) WHERE len(w) >= s
  )
), hit AS (SELECT r, s, i, item_id FROM occurring JOIN win USING (s, t)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + s)) AS p FROM hit) GROUP BY 1),
listed AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS digest FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN listed USING (r)
"""


def queries():
    return {"op1_bpe": op1_bpe, "op2_langid": op2_langid, "op3_simhash": op3_simhash, "op4_pii": op4_pii, "op5_embeddings": op5_embeddings, "op6_quality": op6_quality, "op7_packing": op7_packing, "op8_lm": op8_lm, "op9_topk": op9_topk, "op10_tokenfile": op10_tokenfile, "op11_search": op11_search, "op12_winnowing": op12_winnowing, "op13_merkle": op13_merkle}


def oracle_sql():
    return {"op9_topk": OP9_SQL, "op11_search": OP11_SQL, "op12_winnowing": OP12_SQL}
