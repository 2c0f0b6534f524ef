import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from quarry.llm import bpe


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    want, have = _reference(), bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    texts = ["", " ", "a" * 5000, "ab" * 3000, "xyzzy" * 900, "é" * 700, "it's they'll  \n\n x\t\x1c\x85 y", "<|endoftext|>", "中文" * 500, "0123456789" * 300, "!?" * 999]
    for _ in range(400):
        alphabet = rng.choice(["ab", "abc \n", "the and of", "éèü ß'sd", "0123 .,", "".join(map(chr, range(32, 800)))])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.choice([3, 30, 300]))))
    for text in texts:
        ids = want.encode_ordinary(text)
        packed = have.encode(text)
        assert list(memoryview(packed).cast("I")) == ids, text[:80]
        assert have.decode(packed) == text.encode()


def test_query_and_edges(spark):
    from quarry.llm import queries

    rows = [(1, None), (2, ""), (3, "the  end\n"), (3, "the  end\n"), (None, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'c' as ids", "1 as decoded")
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((a or 0, b or "") for a, b in rows)
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0
    got = queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    e = _reference()
    assert len(got) == len(texts)
    for r in got:
        ids = e.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_every_code_point_splits_as_in_the_library():
    """Alone, before a contraction, and after a letter, a digit and a space; code points that aren't assigned included."""
    want, have = _reference(), bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 16384):
        own = [chr(c) for c in every[i : i + 16384]]
        for context in ("{}", "{}'m", "a{}", "1{}", " {}"):
            text = "!".join(map(context.format, own))
            assert list(memoryview(have.encode(text)).cast("I")) == want.encode_ordinary(text), (hex(every[i]), context)
    for text in ("\u0558'm", "\u0558\u058b\u0378", "a\u0558 \u0378b"):
        assert list(memoryview(have.encode(text)).cast("I")) == want.encode_ordinary(text)
