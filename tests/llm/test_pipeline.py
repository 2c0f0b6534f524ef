import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import langid, packing, pii, quality, simhash

from .test_classifiers import _rates, clip
from .test_neardup import _components
from .test_pii import brute


def _kept(spark, sf):
    """Ids and texts that reach the last stage, by plain Python."""
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda d: d.doc_id)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = langid.fit(langid.training_part(spark.read.parquet(f"{sf}/documents.parquet")))
    docs = [d for d in docs if (p := model.predict(d.text))[0] != "und" and p[1] >= model.reject]
    x = np.array([quality.features(d.text) for d in docs])
    at = [i for i, d in enumerate(docs) if d.doc_id in labels]
    rows = sorted((tuple(x[i]), float(labels[docs[i].doc_id] > 0)) for i in at)
    lx, ly = np.array([r for r, _ in rows]), np.array([y for _, y in rows])
    m = quality.train(lx, ly)
    e = m.evidence(x)
    p = [1 / (1 + math.exp(-(v + m.base))) for v in e]
    paths = [(d.source, f"{d.source}/{d.lang}") for d in docs]
    host, rate = _rates(([d.source for d in docs], [b for _, b in paths]), p)
    odds = []
    for v, own, key in zip(e, p, paths):
        _, n, good, strength = rate[key]
        prior = clip((strength * host[key[0]] + good - own) / (strength + n - 1))
        odds.append(v + math.log(prior / (1 - prior)))
    threshold = min(0.0, np.quantile([o for o, d in zip(odds, docs) if labels.get(d.doc_id)], 0.002))
    docs = [d for d, o in zip(docs, odds) if o >= threshold]
    fps = [simhash.fingerprint(d.text) for d in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    docs = [d for i, (d, c) in enumerate(zip(docs, _components(len(docs), links))) if i == c]
    out = {}
    for d in docs:
        text, at, parts = d.text, 0, []
        for start, kind, end in brute(text):
            if start >= at:
                parts += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, end)
        out[d.doc_id] = "".join(parts) + text[at:]
    return out


def test_pipeline(spark, sf):
    want = _kept(spark, sf)
    got = corpus_pipeline.run(spark, sf).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(want)
    total = 0
    for i, text in want.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * total / 2048 + 2


def test_stages_keep_the_columns_and_survive_empty_and_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "s", 0), (2, "the same words here", "en", "s", 19), (2, "the same words here", "en", "s", 19), (3, "a very long text of many words " * 20_000, "en", "s", 1)], docs.schema).withColumn("keep", F.lit(1))
    for table in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert corpus_pipeline.drop_near_duplicates(spark, odd, sf).count() == 3
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7777")
    corpus_pipeline.run(spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7777"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", setting)
