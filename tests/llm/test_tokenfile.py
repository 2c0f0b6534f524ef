import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, tokenfile, tokens

WORD = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49407), st.integers(0, 2**64 - 1)), max_size=700))
def test_words_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, offsets = tokenfile.encode(v)
    assert len(offsets) == -(-len(v) // tokenfile.BLOCK)
    assert (tokenfile.decode(words, len(v)) == v).all()
    payload = tokenfile.to_segment(np.array([len(v)]), v)
    counts, ids = tokenfile.from_segment(payload)
    assert counts.tolist() == [len(v)] and (ids == v).all()
    for b in range(len(offsets)):
        assert (tokenfile.decode_block(payload, b) == v[b * 128 : b * 128 + 128]).all()


def test_cached_encoding_equals_whole_texts():
    rng = random.Random(2)
    texts = ["", None, "It's  THE end\n", "İSTANBUL ΣΑΣ Ça é x", "中文 <|endoftext|> a", "A" * 3000, "'S 'LL don'T 12345 ½ …"]
    texts += ["".join(rng.choice(rng.choice(["abc ABC'", "ÀÉßſ K", "\x1c\x85\xa0 \n\t", "".join(map(chr, range(32, 900)))])) for _ in range(60)) for _ in range(500)]
    for path, pattern, lower in ((WORD, tokens.pattern_of(WORD), True), (P.path("byte_bpe_50k.json"), P.PATTERN, False)):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        have = tokens.Encoder(path, pattern, lower).encode(texts)
        for text, ids in zip(texts, have, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_added_tokens_as_by_the_library(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>Y  z", "<|ENDOFTEXT|> <|endoftext| >", "中文 <|endoftext|> a", "It's <|startoftext|>\n'LL", "plain"]
    for path, pattern, lower in ((WORD, tokens.pattern_of(WORD), True), (P.path("byte_bpe_50k.json"), P.PATTERN, False)):
        t = Tokenizer.from_file(path)
        for text, ids in zip(texts, tokens.encoder(path, pattern, lower).encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenfile.write(df, str(tmp_path / "a"), WORD, tokens.pattern_of(WORD))
    t, at = Tokenizer.from_file(WORD), 0
    for r in sorted(tokenfile.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start):
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, bytes(r.ids)) == (at, np.array(ids, "<u4").tobytes())
        at += len(ids)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pieces(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    for i, text in enumerate(texts):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist()[: len(t.encode(text, add_special_tokens=False).ids)] == t.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = [(5, "five five"), (None, "none"), (3, None), (3, ""), (9, "x" * 50_000), (-2, "minus")] + [(100 + i, f"doc {i} of many") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as file", "2 as payload")
    t = Tokenizer.from_file(WORD)
    for n, path in ((1, str(tmp_path / "a")), (5, str(tmp_path / "b"))):
        tokenfile.write(df, path, WORD, tokens.pattern_of(WORD), files=n, segment_ids=64)
        got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
        at = 0
        texts = {i: x for i, x in rows if i != 3}
        for r in got:
            ids = [*t.encode((texts.get(r.doc_id) or "") if r.doc_id != 3 else "", add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
            at += len(ids)
    tokenfile.write(df.limit(0), str(tmp_path / "c"), WORD, tokens.pattern_of(WORD))
    assert tokenfile.read(spark, str(tmp_path / "c")).count() == 0


def test_query(spark, sf):
    from quarry.llm import queries

    t = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op10_tokenfile(spark, sf).collect()}
    at = 0
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_hoisted_patterns_match_alike():
    import regex

    from quarry.llm import split

    rng = random.Random(9)
    atoms = ["a", "bc", "'s", "'", "'re", "1", "23", " ", "  ", "\n", "!?", "é", "<", "|"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for pattern in (tokens.pattern_of(WORD), P.PATTERN, r"x|[a-c]+|'s|[^a-c]", r"ab|[a-c]+|[0-9]"):
        moved = split.hoisted(pattern)
        assert all(regex.findall(pattern, t) == regex.findall(moved, t) for t in texts), moved
    assert split.hoisted(r"ab|[a-c]+") == r"ab|[a-c]+" and split.hoisted(r"x|[a-c]+") == r"[a-c]+|x"
