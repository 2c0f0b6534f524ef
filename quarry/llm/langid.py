"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the 1- to 4-byte grams of its letters in lower case, in UTF-8, with a space on each side of a
word and none across words. Each has a row of an embedding table by its hash; the text's vector is the average over all
its subwords, and a linear softmax gives the languages. Both are trained together by stochastic gradient descent in
numpy, on the driver, from a bounded sample of labelled rows: about `per_lang` rows of each language, those with the
smallest hashes of their ids (features are made on the executors, so that what reaches the driver has a bound whatever the
lengths of the texts). As both layers are linear, the executors get one table of subword logits.

Rejection: the softmax has one more class for what is no known language. Its examples are made from the sample's texts:
letters shuffled over the text or turned round in each word, random letters, consonants, other scripts, at all lengths.
A fifth of the sample, held out, calibrates a temperature and the score below which a text is rejected: between the
scores of held texts of the languages (of which at most the share `lost` may be rejected) and those of held strange
ones, half-way in log-odds (nearer to the strange ones if few known ones are held); where the two overlap, texts of the languages have priority.

Edge cases: a null text, or one without a letter, is `und` with score 0 and is rejected; so is every text if no row
is labelled. Texts are taken whole. Equal scores go to the language first in order. Repeated rows each give a row. Other
columns pass through, whatever their names, unless they bear an output's. More languages than max_langs raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, fresh, stored, trim_memory
from .split import PLAIN, departs, members

BUCKETS = 1 << 15
GRAMS = 4
CHUNK = 1 << 18
LETTERS = (r"\p{L}",)
NOT_LETTERS = regex.compile(r"\P{L}+")


def letters_of(text: str) -> str:
    """A text's letters in lower case, runs of all else as one space."""
    text = text.lower()
    if not PLAIN(text) and departs(text, LETTERS):  # the regex library takes some for letters that aren't
        own = members(LETTERS[0])
        text = "".join(c if own[ord(c)] else " " for c in text)
    return NOT_LETTERS.sub(" ", text)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, a chunk at a time."""
    if not text:
        return
    letters = letters_of(text).strip()
    if not letters:
        return
    raw = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8)
    for begin in range(0, len(raw), CHUNK):
        b = raw[begin : begin + CHUNK + GRAMS - 1].astype(np.uint32)
        space = b == 32
        code, inside = np.zeros(len(b), dtype=np.uint32), np.ones(len(b), dtype=bool)
        for n in range(1, GRAMS + 1):
            size = min(len(b) - n + 1, CHUNK)
            if size <= 0:
                break
            code = code[:size] * np.uint32(257) + b[n - 1 : n - 1 + size] + np.uint32(1)
            if n > 2:
                inside = inside[:size] & ~space[n - 2 : n - 2 + size]
            keep = inside[:size] if n > 1 else ~space[:size]
            yield ((code[keep] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for found in grams(text):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


#: First and last letters of scripts to make strange texts of.
SCRIPTS = [("α", "ω"), ("а", "я"), ("א", "ת"), ("ا", "ي"), ("अ", "ह"), ("ก", "ฮ"), ("ぁ", "ゖ"), ("가", "힣"), ("一", "龥")]
STRANGE_CHARS = 2000


def strange(text: str, rng: np.random.Generator) -> str:
    """A text of no language, made from at most STRANGE_CHARS letters of a text."""
    words = letters_of(text)[:STRANGE_CHARS].split()
    words = words[: int(np.ceil(len(words) * rng.random() ** 2))] or ["a"]
    kind = rng.integers(0, 5)
    if kind == 0:
        return " ".join(w[::-1] for w in words)
    if kind == 1:
        letters = rng.permutation(list("".join(words)))
    else:
        n = sum(map(len, words))
        a, z = SCRIPTS[rng.integers(0, len(SCRIPTS))]
        pool = {2: "abcdefghijklmnopqrstuvwxyz", 3: "bcdfghjklmnpqrstvwxz"}.get(int(kind)) or "".join(map(chr, range(ord(a), ord(z) + 1)))
        letters = np.array(list(pool))[rng.integers(0, len(pool), n)]
    ends = np.cumsum([len(w) for w in words])
    return " ".join("".join(letters[e - len(w) : e]) for w, e in zip(words, ends, strict=True))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # [bucket, language, and a last column for none], summed and divided by the number of subwords
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs) + 1), 0
        for found in grams(text):
            n += len(found)
            counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 4 else None
            total += counts @ self.logits if counts is not None else self.logits[found].sum(axis=0, dtype=np.float64)
        if not n or not self.langs:
            return "und", 0.0
        p = softmax((total / n + self.bias) / self.temperature)
        best = int(p[:-1].argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str | None, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 8, rate: float = 2.0, lost: float = 0.001, seed: int = 7) -> Model:
    """A model from (language or None for strange texts, buckets, counts); lost: the share of the languages' calibration rows that may be rejected."""
    langs = sorted({lang for lang, at, _ in rows if lang is not None and len(at)})
    place = {lang: i for i, lang in enumerate(langs)} | {None: len(langs)}
    rows = [(place[lang], at, c / c.sum()) for lang, at, c in rows if len(at)]
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    held = rows[: len(rows) // 5]
    fit = rows[len(held) :]
    table = rng.normal(0, 0.1, (BUCKETS, dim))
    weight, bias = np.zeros((dim, len(langs) + 1)), np.zeros(len(langs) + 1)
    weight += rng.normal(0, 0.1, weight.shape)
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, at, share = fit[i]
            mean = share @ table[at]
            slope = softmax(mean @ weight + bias)
            slope[y] -= 1
            pace = rate * (1 - step / steps)
            back = weight @ slope
            weight -= pace * 0.1 * np.outer(mean, slope)
            bias -= pace * 0.01 * slope
            table[at] -= pace * 5 * share[:, None] * back[None, :]
            step += 1
    logits = table @ weight
    model = Model(langs, logits, bias, 1.0, 0.0)
    if held and langs:
        z = np.array([share @ logits[at] + bias for _, at, share in held])
        y = np.array([y for y, _, _ in held])
        losses = [(-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 26)]
        model.temperature = float(min(losses)[1])
        score = softmax(z / model.temperature)[:, :-1].max(axis=1)
        model.reject = between(score[y < len(langs)], score[y == len(langs)], lost)
    model.logits = logits.astype(np.float32)
    return model


def between(known: np.ndarray, odd: np.ndarray, lost: float) -> float:
    """The score from which a text is accepted, given scores of texts of known languages and of strange ones."""
    if not len(known):
        return 0.0
    log_odds = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    high = np.quantile(log_odds(known), lost)
    low = np.quantile(log_odds(odd), 0.99) if len(odd) else -np.inf
    # Half-way; nearer to the strange ones where the known are too few to tell where their lowest scores lie.
    bound = low + (high - low) * 0.5 * min(1.0, len(known) * lost) if -np.inf < low < high else high
    return float(1 / (1 + np.exp(-bound)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, max_langs: int = 256, **training) -> Model:
    """Train on the rows of docs with a language: about per_lang of each, and half as many strange texts made of them."""
    rows = fresh(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    common = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if common.count() > max_langs:
        raise ValueError(f"more than {max_langs} languages: the table of logits has a column for each; raise max_langs, or clean {lang_col}")
    # A row is chosen by the hash of its id alone: no sort, and no language's rows meet in one task.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.join(F.broadcast(common), "lang").where(share < per_lang / F.col("n")).select("text", "lang", F.xxhash64("doc_id").alias("order"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, order in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = [(lang, *features(text))]
                if order % 2 and text:
                    found.append((None, *features(strange(text, np.random.default_rng(order % 2**32)))))
                for name, at, c in found:
                    row = [name], [at.astype("<i4").tobytes()], [c.astype("<i8").tobytes()], [order]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["lang", "buckets", "counts", "order"])

    made = chosen.mapInArrow(each, "lang string, buckets binary, counts binary, order long")
    # The hash keeps the sample near its size; where many rows share one id, the bound holds all the same.
    got = made.orderBy("order", "lang", "buckets", "counts").limit(3 * per_lang * max(1, common.count())).collect()
    # An order of their own, so that the same rows always give the same model.
    parts = sorted(((r.lang, bytes(r.buckets), bytes(r.counts)) for r in got), key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))
    return train([(lang, np.frombuffer(a, "<i4"), np.frombuffer(c, "<i8")) for lang, a, c in parts], **training)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and accepted (the score is not rejected). Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS rows, at most max_langs + 1 columns
    kept = df.drop("lang_pred", "score", "accepted")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *fields])
    at = kept.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [own.predict(x) for x in part.column(at).to_pylist()]
                lang, score = [x for x, _ in found], [x for _, x in found]
                accepted = [x != "und" and s >= own.reject for x, s in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=schema.names)
        trim_memory()

    return kept.mapInArrow(each, schema)


def training_part(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from; the others (remainder 1) are held out."""
    return docs.where(crc_bucket(F.col(id_col), 3) != 1)
