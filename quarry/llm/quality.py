"""Quality classification by hierarchical empirical Bayes.

Evidence: a logistic regression on the form of a text (shares of symbols, capitals, digits, repeats and so on), fitted on
all labelled rows, gives each document a log-likelihood ratio: its log-odds less those of the labelled rows. Forms are
found once and stored; each of Newton's steps is a job that sums slopes and curvatures, of which 240 numbers come back.

Sites: every host, and every path in a host, has a rate of good documents. Its posterior mean is
(strength * parent's rate + sum of the classifier's probabilities) / (strength + documents): sparse sites stay near
their parent, large ones speak for themselves. The parent of a path is its host, that of a host the whole corpus. The
strength of each level is estimated from the corpus by moments: the variance between sites beyond what sampling
explains. All of it comes from one grouped aggregation per level, combined before the shuffle.

A document's posterior log-odds are its evidence plus the log-odds of its prior: its path's rate without the document
itself, which would otherwise count twice. A document is kept if its posterior is at least a threshold: 0, or less if
more than the share `lost` of all good labelled documents would fall below: an exact quantile, found by counts of bins.

Edge cases: a null text counts as empty and has a score like any other; null hosts and paths form a site of their own.
Without any labels, or with labels of one kind only, the evidence is 0 and all documents are kept. Several labels for
one id: the largest counts; several rows of a labelled id: the one whose features come first trains, and the lowest
posterior sets the threshold. Repeated rows each give a row. Other columns pass through, whatever their names, unless
they bear an output's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored, trim_memory

OUTPUTS = ["evidence", "host_rate", "path_rate", "quality", "keep"]
NAMES = ["symbols", "capitals", "digits", "spaces", "lines", "bars", "bangs", "stops", "high", "word_length", "repeats", "distinct", "tails", "shouts"]
_KIND = np.zeros((256, 9), dtype=np.int64)
for _i, _set in enumerate([b"#$%&*@^~<>{}[]\\=+_", bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b"|", b"!?", b".,;:", bytes(range(128, 256))]):
    _KIND[list(_set), _i] = 1


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _KIND / n
    return np.array(
        [
            *np.sqrt(shares),
            min(20.0, len(raw) / w),
            sum(map(eq, words, words[1:])) / w,
            len(set(words)) / w * np.log1p(w),
            sum(x[-1:] in b"#$%&*!" for x in words) / w,
            sum(map(bytes.isupper, words)) / w,
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last one is the constant
    base: float  # log-odds of the labelled rows
    good: DataFrame | None = None  # ids of the good labelled documents, which set the threshold
    lost: float = 0.0

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weight[:-1] + self.weight[-1] - self.base, -30, 30)

    def evidence_of(self, x):
        """The same of a column of features."""
        terms = [(x[i] - float(m)) * float(w) for i, (m, w) in enumerate(zip(self.mean, self.weight[:-1] / self.scale, strict=True))]
        total = sum(terms[1:], terms[0]) + float(self.weight[-1] - self.base)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _sums(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the rows add to the slope, and below it to the curvature, of the log-likelihood."""
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
    return np.r_[(p - y) @ z, ((z * (p * (1 - p))[:, None]).T @ z).ravel()]


def _newton(n: int, good: float, mean: np.ndarray, scale: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], ridge: float = 1e-2, steps: int = 40) -> Model:
    """Newton's method with a ridge; classes count as they come. sums: _sums of all rows with a weight."""
    width = len(mean) + 1
    weight = np.zeros(width)
    penalty = np.full(width, ridge)
    penalty[-1] = 0
    for _ in range(steps):
        found = sums(weight) / n
        change = np.linalg.solve(found[width:].reshape(width, width) + np.diag(penalty + 1e-9), found[:width] + penalty * weight)
        weight = weight - change
        if np.abs(change).max() < 1e-8:
            break
    return Model(mean, scale, weight, float(np.log(good / (n - good))))


def _unlearned() -> Model:
    width = len(NAMES)
    return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.0)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> Model:
    """The model of rows in memory."""
    if len(y) == 0 or y.min() == y.max():
        return _unlearned()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return _newton(len(y), y.sum(), mean, scale, lambda weight: _sums(x, y, mean, scale, weight), ridge, steps)


def _measured(rows: DataFrame, text: Callable[[pa.RecordBatch], pa.Array], kept: list[str]) -> DataFrame:
    """The columns kept, and x: the features of the texts that text() takes from a batch."""
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                x = np.array([features(t) for t in text(part).to_pylist()])
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], names=schema.names)
        trim_memory()

    return rows.mapInArrow(each, schema)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lost: float = 0.002) -> Model:
    """The evidence model, from the rows of all labelled ids."""
    return _fitted(_measured(fresh(docs, id_col, text_col).toDF("id", "text"), lambda part: part.column("text"), ["id"]), labels, id_col, label_col, lost)


def _fitted(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, lost: float) -> Model:
    """The model, from (id, x) of all documents: texts stay where they are, and only forms are joined with the labels."""
    known = fresh(labels, id_col, label_col).toDF("id", "y").where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    forms = measured.where("id is not null").groupBy("id").agg(F.min("x").alias("x"))
    rows = stored(forms.join(known, "id").select("id", "x", (F.col("y") > 0).cast("double").alias("y")), "labelled")
    columns = [F.col("x")[i] for i in range(len(NAMES))]
    n, good, *moments = rows.agg(F.count("*"), F.sum("y"), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    if not n or good in (0, n):
        return _unlearned()
    mean, scale = np.array(moments[: len(NAMES)]), np.array(moments[len(NAMES) :]) + 1e-6

    def sums(weight: np.ndarray) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(_sums(_matrix(b.column("x")), b.column("y").to_numpy(), mean, scale, weight) for b in batches if b.num_rows)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        found = rows.select("x", "y").mapInArrow(each, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(found)])

    model = _newton(n, good, mean, scale, sums)
    model.good, model.lost = rows.where("y > 0").select("id"), lost
    return model


def quantile(values: DataFrame, share: float, bins: int = 1000) -> float | None:
    """np.quantile of the table's one column of finite numbers, exactly; None if it is empty.

    The range in which the value's two neighbours lie is cut into bins, of which only counts and ends come to the driver,
    until they lie in two bins or are equal.
    """
    values = stored(values.toDF("v"), "values")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = share * (n - 1)
    first = int(at)
    part, below = at - first, 0  # below: how many values are less than low
    second = min(first + 1, n - 1)
    while low < high:
        bin_ = F.floor((F.col("v") - low) / (high - low) * bins).alias("bin")
        cut = values.where(F.col("v").between(low, high)).groupBy(bin_).agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        cut = sorted(cut, key=lambda r: r.low)
        ends = below + np.cumsum([r.k for r in cut])
        i, j = np.searchsorted(ends, [first, second], side="right")
        if i != j:
            return cut[i].high + (cut[j].low - cut[i].high) * part
        low, high, below = cut[i].low, cut[i].high, int(ends[i]) - cut[i].k
    return low


def logit(p):
    return F.log(p / (1 - p))


def _level(parts: DataFrame, by: list[str], low: float = 1.0, high: float = 1e4) -> tuple[DataFrame, float]:
    """Rates of the sites `by`, from (by, n, good, rate of the parent), shrunk with a strength from the level's moments; and the strength."""
    sites = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("parent").alias("parent"))
    # With weights n: E[sum n (rate_i - parent)^2] = k * v + between * (sum n), v = parent (1 - parent) at most.
    deviation = F.pow(F.col("good") / F.col("n") - F.col("parent"), 2)
    found = sites.agg(
        F.sum(F.col("n") * deviation).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))).alias("unit")
    ).first()
    strength = high
    if found.n and found.k > 1:
        unit = found.unit / found.n
        between = (found.spread - found.k * unit) / found.n
        if between > 0 and unit > between:
            strength = unit / between
    strength = min(high, max(low, strength))
    rate = (strength * F.col("parent") + F.col("good")) / (strength + F.col("n"))
    return sites.withColumn("rate", _clipped(rate)), strength


def _clipped(rate):
    return F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate))


def _rows(docs: DataFrame, host, path, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """docs in a struct row_ (without text_col unless keep_text), with id, host, path and the features x: stored, as texts are read once."""
    host, path = (F.coalesce((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string"), F.lit("\0")) for c in (host, path))
    own = {"id": F.col(f"`{id_col}`"), "host": host, "path": path}
    away = [c for c in docs.columns if c.lower() in OUTPUTS or (c == text_col and not keep_text)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in away]).alias("row_"), *[c.alias(n) for n, c in own.items()], *([] if keep_text else [F.col(f"`{text_col}`").alias("text")]))
    at = [c for c in docs.columns if c not in away].index(text_col) if keep_text else -1
    text = (lambda part: part.column("row_").field(at)) if keep_text else (lambda part: part.column("text"))
    return stored(_measured(rows, text, ["row_", *own]), "forms")


def score(docs: DataFrame, model: Model, host, path, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without text_col unless keep_text) with evidence, host_rate, path_rate, quality (posterior probability) and keep.

    host, path: columns or names.
    """
    return _scored(_rows(docs, host, path, id_col, text_col, keep_text), model)


def classify(docs: DataFrame, labels: DataFrame, host, path, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lost: float = 0.002, keep_text: bool = True) -> DataFrame:
    """score() with the model that fit() gives of the same docs; texts are read once for both."""
    rows = _rows(docs, host, path, id_col, text_col, keep_text)
    return _scored(rows, _fitted(rows.select("id", "x"), labels, id_col, label_col, lost))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    rated = rows.withColumn("evidence", model.evidence_of(F.col("x"))).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + model.base))))
    # Which rows are good by the classifier, summed up by path.
    parts = stored(rated.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "parts")
    whole = parts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    top = min(0.999, max(0.001, whole.good / whole.n)) if whole.n else 0.5
    hosts = _level(parts.withColumn("parent", F.lit(top)), ["host"])[0]
    hosts = stored(hosts.select("host", F.col("rate").alias("host_rate")), "hosts")
    paths, strength = _level(parts.join(hosts, "host").withColumn("parent", F.col("host_rate")), ["host", "path"])
    sites = stored(paths.select("host", "path", "n", "good", F.col("parent").alias("host_rate"), F.col("rate").alias("path_rate")), "sites")
    # A document's prior leaves out the document itself.
    prior = _clipped((strength * F.col("host_rate") + F.col("good") - F.col("p")) / (strength + F.col("n") - 1))
    out = rated.join(sites, ["host", "path"]).withColumn("odds", F.col("evidence") + logit(prior))
    threshold = -np.inf
    if model.good is not None:
        lowest = out.groupBy("id").agg(F.min("odds").alias("odds")).join(model.good.toDF("known"), F.col("id") == F.col("known")).select("odds")
        threshold = min(0.0, quantile(lowest, model.lost) or 0.0)
    keep = F.col("odds") >= threshold if np.isfinite(threshold) else F.lit(True)
    return out.select("row_.*", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-F.col("odds")))).alias("quality"), keep.alias("keep"))
