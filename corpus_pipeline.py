"""From documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents, but for
the last one, which returns pieces with their places. docs may be any table with these columns; others pass through,
whatever their names, but for those named like an output of a classifier (lang_pred, score, accepted; evidence,
host_rate, path_rate, quality, keep), which come out with its values.

Edge cases, by stage: texts are taken whole, however long, and an empty table gives an empty one throughout.
language ID drops null, empty and letterless texts and, where no row has a language, all; quality takes a null text
as empty and null sources and languages as sites of their own; near-dedup gives null and empty texts one fingerprint,
so one of them stays, and of repeated rows one; PII leaves null texts null; packing takes them as empty: one piece of
the end id. A null doc_id never trains, and is kept or dropped like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import langid, packing, pii, quality, simhash
from quarry.llm.common import stored, text_batches
from quarry.llm.queries import section


def identify_language(spark, docs, sf_dir):
    """Drops documents without a letter and those whose language the model rejects."""
    model = langid.fit(langid.training_part(text_batches(docs)))
    return langid.predict(docs, model).where("accepted").select(*docs.columns)


def classify_quality(spark, docs, sf_dir):
    """Drops documents whose posterior log-odds of being good are below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(text_batches(docs), labels, "source", section(F.col("source"), F.col("lang"))).where("keep").select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_one(text_batches(docs))


def redact_personal_data(spark, docs, sf_dir):
    """Replaces personal data; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark, docs, sf_dir):
    """Cuts and packs the documents' ids into sequences."""
    # The same workers hold what the other stages need: a smaller cache than packing alone could have.
    found = packing.pieces(text_batches(docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, cache_entries=40_000)
    return packing.pack(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Models, fingerprints and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)  # texts have been encoded when it returns
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", setting)
