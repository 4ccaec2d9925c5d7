"""The sketch of the polynomial kernel against the exact Gram matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scorewise.operators import classify


def test_gram_matrix_of_500_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 40))
    exact = (0.5 * x @ x.T) ** 3
    size = 0.5**3 * np.outer((x**2).sum(1) ** 1.5, (x**2).sum(1) ** 1.5)
    errors = []
    for width in (256, 1024, 4096):
        z = classify.TensorSketch(40, 3, width, 0.5, 7)(x)
        errors.append(np.sqrt((((z @ z.T - exact) / size) ** 2).mean()))
        assert errors[-1] < np.sqrt(27 / width)
    assert errors[0] > errors[1] > errors[2]  # wider is closer
    means = np.mean([(lambda z: z[:20] @ z[20:40].T)(classify.TensorSketch(40, 3, 256, 0.5, s)(x[:40])) for s in range(300)], axis=0)
    assert abs((means - exact[:20, 20:40]) / size[:20, 20:40]).max() < 0.03  # unbiased


def test_sketched_rows(spark):
    rows = spark.range(30).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = classify.tensor_sketch(rows, "v", 2, 3, 16, 1.0, 3).orderBy("id").collect()
    wanted = classify.TensorSketch(2, 3, 16, 1.0, 3)(np.array([[float(i), 1.0] for i in range(30)]))
    assert np.allclose([r["features"].toArray() for r in got], wanted)
    assert classify.tensor_sketch(rows.limit(0), "v", 2, 3, 16, 1.0, 3).collect() == []
