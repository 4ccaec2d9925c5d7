"""Classifier helpers over Spark ML: fit / score, cross-validated grids,
random-Fourier-feature maps and the per-model metrics row.

Cross-validation takes (training rows, held-out rows) pairs, so a caller can
balance each training part without touching the rows it is judged on.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even
from scorewise.operators import evaluate
from scorewise.operators.neighbors import _as_matrix


def positive_score(pred: DataFrame, prob_col: str = "probability", name: str = "score") -> DataFrame:
    """Probability of class 1 as a double column (falls back to the hard prediction)."""
    if prob_col in pred.columns:
        return pred.withColumn(name, vector_to_array(F.col(prob_col))[1])
    if name in pred.columns:  # the caller already supplied a score (votes, averaged bags)
        return pred
    return pred.withColumn(name, F.col("prediction").cast("double"))


def metrics_row(pred: DataFrame, model: str, label: str = "label", scale: int = 3) -> DataFrame:
    """One row: model, accuracy, precision, recall, f1, specificity, auc (from scores)."""
    scored = positive_score(pred)
    row = evaluate.scored_metrics(scored, label, "prediction", "score").select(F.lit(model).alias("model"), "*")
    return row.select("model", *[round_even(c, scale).alias(c) for c in row.columns if c != "model"])


def fit_score(estimator: Estimator, train: DataFrame, test: DataFrame, model: str) -> tuple[object, DataFrame]:
    fitted = estimator.fit(train)
    return fitted, metrics_row(fitted.transform(test), model)


def hit_rate(model, rows: DataFrame) -> float:
    return float(model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])


def k_fold(estimator: Estimator, splits: list[tuple[DataFrame, DataFrame]], parallelism: int = 4) -> list[float]:
    """Held-out accuracy of each (training rows, held-out rows) pair."""
    with ThreadPool(parallelism) as pool:
        return pool.map(lambda s: hit_rate(estimator.fit(s[0]), s[1]), splits, chunksize=1)


def grid_search(estimator, grid, splits: list[tuple[DataFrame, DataFrame]], parallelism: int = 4) -> DataFrame:
    """Mean held-out accuracy of every grid point (point, params, mean_accuracy, is_best)."""
    jobs = [(point, train, held) for point in grid for train, held in splits]
    with ThreadPool(parallelism) as pool:
        found = pool.map(lambda j: hit_rate(estimator.fit(j[1], j[0]), j[2]), jobs, chunksize=1)
    means = [sum(found[i * len(splits) : (i + 1) * len(splits)]) / len(splits) for i in range(len(grid))]
    return grid_table(splits[0][0].sparkSession, [{p.name: v for p, v in point.items()} for point in grid], means)


def grid_table(spark, points: list[dict], means: list[float]) -> DataFrame:
    """The rows of a grid: each point's parameters by name, its mean accuracy, and the best one (first on ties)."""
    best = int(np.argmax(means))
    rows = [(i, ", ".join(f"{k}={v}" for k, v in sorted(point.items())), float(mean), i == best) for i, (point, mean) in enumerate(zip(points, means))]
    table = spark.createDataFrame(rows, "point INT, params STRING, mean_accuracy DOUBLE, is_best BOOLEAN")
    return table.select("point", "params", round_even("mean_accuracy", 6).alias("mean_accuracy"), "is_best")


def random_fourier_features(
    df: DataFrame, vec_col: str, dim: int, n_features: int, gamma: float, seed: int, out: str = "features"
) -> DataFrame:
    """z(x) = sqrt(2/D) cos(x W + b), W ~ N(0, 2γ), b ~ U(0, 2π) (Rahimi & Recht).

    W is drawn once on the driver (D × p, bounded by parameters) and applied
    per Arrow batch with numpy.
    """
    rng = np.random.RandomState(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    keep = [c for c in df.columns if c != vec_col]
    schema = df.select(*keep).schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for pdf in batches:
            x = _as_matrix(pdf[vec_col])
            z = scale * np.cos(x @ w + b) if len(x) else np.zeros((0, n_features))
            res = pdf[keep].copy()
            res["_z"] = list(z)
            yield res

    mapped = df.mapInPandas(run, f"{schema}, _z array<double>")
    return mapped.withColumn(out, array_to_vector("_z")).drop("_z")


class TensorSketch:
    """z(x) with z(x).z(y) close to (gamma * x.y)^degree (Pham & Pagh, 2013).

    Each factor is count-sketched with its own buckets and signs; the sketch of
    the product is the circular convolution of the factors' sketches, a product
    after a Fourier transform.  The estimate is unbiased, its standard error at
    most about sqrt(3^degree / width) * |x|^degree * |y|^degree * gamma^degree.
    """

    def __init__(self, dim: int, degree: int, width: int, gamma: float, seed: int) -> None:
        rng = np.random.RandomState(seed)
        self.width, self.scale = width, math.sqrt(gamma)
        self.tables = np.zeros((degree, dim, width))
        for table in self.tables:
            table[np.arange(dim), rng.randint(0, width, dim)] = rng.choice([-1.0, 1.0], dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        product = 1.0
        for table in self.tables:
            product = product * np.fft.rfft(self.scale * x @ table, axis=1)
        return np.fft.irfft(product, self.width, axis=1)


def tensor_sketch(
    df: DataFrame, vec_col: str, dim: int, degree: int, width: int, gamma: float, seed: int, out: str = "features"
) -> DataFrame:
    """Features whose inner product estimates the kernel (gamma * x.y)^degree; one map, the tables are bounded by parameters."""
    sketch = TensorSketch(dim, degree, width, gamma, seed)
    keep = [c for c in df.columns if c != vec_col]
    schema = df.select(*keep).schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = part.column(vec_col).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(sketch(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), z], [*keep, "_z"])

    mapped = df.select(*keep, vec_col).mapInArrow(run, f"{schema}, _z array<double>")
    return mapped.withColumn(out, array_to_vector("_z")).drop("_z")


def poisson_weight(u) -> object:
    """Poisson(1) draw from a uniform column by inverse CDF (bootstrap weight)."""
    cdf, term, expr, k = 0.0, math.exp(-1.0), None, 0
    branches = []
    while k < 12:
        cdf += term
        branches.append((cdf, k))
        k += 1
        term = term / k
    expr = F.lit(float(k))
    for c, kk in reversed(branches):
        expr = F.when(u < F.lit(c), F.lit(float(kk))).otherwise(expr)
    return expr


def vectors(df: DataFrame, vec_col: str = "v", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec_col)))
