"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: single words (lower case),
and one to three successive word shapes (case, punctuation, length, whether
the word repeats one of the two before).  Each indicator is scaled by the log
ratio of its smoothed counts in the two classes, each text's vector is brought
to length one, and a linear hinge-loss model is fitted to these vectors by dual
coordinate descent.  A logistic curve, fitted to margins of labelled texts that
the descent has not seen, turns margins into scores.

The model is fitted on a bounded sample: at most ``MAX_PER_CLASS`` labelled
texts of each class, those with the smallest hashes of their ids.  Scoring
covers all texts, whole; it is one map without a shuffle.

Defined results: null and empty texts have no features and score by the
model's constant; labels that are null or not 0 or 1 are left out, of several
labels for one id the smallest counts; if a class has no labels the score is
the other's share; equal rows, equal or null ids and extra columns change
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import mix64, offsets_of, pieces, table, utf8
from scorewise.llm.minhash import word_bounds, word_hashes

#: Labelled texts of each class that the model is fitted on, at most.
MAX_PER_CLASS = 4000
BITS = 18
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIZES = np.array([3, 6, 10, 16, 32])
# kinds of bytes: other, lower case, upper case, digit, beyond ASCII; marks stand for themselves
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all rows, and the offsets of each row's."""
    data, rows = utf8(column)
    n = len(rows) - 1
    start, end, row = word_bounds(data, rows)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    exact = word_hashes(data, start, end)
    words = word_hashes(_LOWER[data], start, end)
    kind = _KIND[data]
    # Latin capitals À to Þ are C3 80 to C3 9E in UTF-8
    after_c3 = np.append(False, data[:-1] == 0xC3)
    kind[after_c3 & (data >= 0x80) & (data < 0x9F)] = 2
    kind[data == 0xC3] = 4

    def count(what: int) -> np.ndarray:
        sums = offsets_of((kind == what).astype(np.int64))
        return sums[end] - sums[start]

    size, upper, lower = end - start, count(2), count(1)
    case = np.where(upper == 0, 0, np.where(lower == 0, np.where(upper > 1, 3, 2), np.where(kind[start] == 2, 1, 4)))
    last = data[end - 1]
    mark = np.where((kind[end - 1] == 0), last, 0).astype(np.int64)
    doubled = (mark > 0) & (size > 1) & (data[np.maximum(end - 2, 0)] == last)
    back = np.zeros(len(start), np.int64)
    same = (exact[1:] == exact[:-1]) & (row[1:] == row[:-1])
    back[1:][same] = 1
    again = (exact[2:] == exact[:-2]) & (row[2:] == row[:-2])
    back[2:][again] |= 2
    digit = count(3) > 0
    shape = ((case * 256 + mark) * 2 + doubled) * 4 + back
    shape = (shape * 2 + digit) * 8 + np.searchsorted(_SIZES, size)
    shape = mix64(shape.astype(np.uint64) + np.uint64(77))
    found, owner = [words, shape ^ np.uint64(1)], [row, row]
    for k in (2, 3):
        if len(shape) >= k:
            value = shape[: len(shape) - k + 1].copy()
            for j in range(1, k):
                value = mix64(value * np.uint64(3) + shape[j : len(shape) - k + 1 + j] + np.uint64(k))
            inside = row[: len(value)] == row[k - 1 :]
            found.append(value[inside])
            owner.append(row[: len(value)][inside])
    feature = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    keys = np.unique(np.concatenate(owner) << BITS | feature)
    return keys & ((1 << BITS) - 1), offsets_of(np.bincount(keys >> BITS, minlength=n))


@dataclass
class Model:
    weights: np.ndarray  # of each feature, before texts are brought to length one
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        margin = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            begin = offsets[:-1][full]
            dot = np.add.reduceat(self.weights[features], begin)
            norm = np.sqrt(np.add.reduceat(self.ratios[features] ** 2, begin))
            margin[full] += dot / np.maximum(norm, 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _descend(features: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: dual coordinate descent with shuffled passes (the constant is a feature of value 1)."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            a, b = offsets[i], offsets[i + 1]
            f, v = features[a:b], x[a:b]
            square = float(v @ v) + 1.0
            slope = y[i] * (float(w[f] @ v) + bias) - 1.0
            old = alpha[i]
            alpha[i] = min(max(old - slope / square, 0.0), cost[i])
            step = (alpha[i] - old) * y[i]
            if step:
                w[f] += step * v
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins (smoothed targets, Newton's steps)."""
    good, bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y > 0, 0.5 / good, 0.5 / bad) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin, g.sum()]) + np.array([1e-3 * (a - 1), 0])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(features: np.ndarray, offsets: np.ndarray, label: np.ndarray, smooth: float = 1.0) -> Model:
    """A model from the indicators and labels (0 or 1) of a sample of texts."""
    y = np.where(label == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = float(label.mean()) if len(y) else 0.5
        return Model(np.zeros(0), np.zeros(0), 0.0, 1.0, 0.0, share)
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    counts = [np.bincount(features[y[row] == s], minlength=1 << BITS) + smooth for s in (1, -1)]
    ratios = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    norm = np.sqrt(np.bincount(row, ratios[features] ** 2, len(y)))
    x = ratios[features] / np.maximum(norm, 1e-12)[row]
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def part(keep: np.ndarray) -> tuple[np.ndarray, float]:
        inside = keep[row]
        return _descend(features[inside], offsets_of(np.diff(offsets)[keep]), x[inside], y[keep], cost[keep])

    seen = np.arange(len(y)) % 4 != 0  # the curve is fitted to margins of texts not seen by the descent
    w, bias = part(seen) if len(set(y[seen])) == 2 and (~seen).any() else part(np.ones(len(y), bool))
    margin = np.bincount(row, w[features] * x, len(y)) + bias
    slope, shift = _curve(margin[~seen], y[~seen]) if len(set(y[~seen])) == 2 else _curve(margin, y)
    w, bias = part(np.ones(len(y), bool))
    return Model(w * ratios, ratios, bias, slope, shift)


def crc(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on ``labels`` (doc_id, label) of ``docs`` (doc_id, text); the caller has left out what must be unseen."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    some = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(some[0].unionAll(some[1]))  # 2 * per_class rows at most
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text"):
                features, offsets = indicators(part.column("text"))
                raw, cuts = features.astype("<i4").tobytes(), (offsets * 4).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "label", "features"])

    got = texts.mapInArrow(run, "doc_id long, label int, features binary").toPandas()
    got = got.sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    sizes = got["features"].map(len).to_numpy(np.int64) // 4 if len(got) else np.zeros(0, np.int64)
    features = np.frombuffer(b"".join(got["features"]), "<i4").astype(np.int64)
    return fit(features, offsets_of(sizes), got["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the score as ``out``: one row per text.

    Only the texts go to Python and only the scores come back; Spark keeps the other columns.
    """

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [model.scores(*indicators(part.column("text"))) for part in pieces(batch, "text")]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    scored = F.arrow_udf(run, "double")
    return docs.select(*keep, scored(F.col("text")).alias(out))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fitted on labels of rows whose crc32(doc_id) mod 5 is not 0."""
    return train(docs, table(spark, sf_dir, "labels").filter(crc("doc_id") % 5 != 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, quality_model(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns."""
    out = "_quality"
    while out in docs.columns:
        out = "_" + out
    return score(docs, quality_model(spark, docs, sf_dir), docs.columns, out).filter(F.col(out) >= THRESHOLD).drop(out)
