"""The axes of the MLP grid change what is fitted."""

import numpy as np
from pyspark.sql import functions as F

from scorewise.operators import classify
from scorewise.plans import classifiers


def test_solver_and_step_size_change_the_weights(spark):
    n = F.col("id")
    rows = spark.range(0, 80, 1, 2).select((n % 2).cast("double").alias("label"), F.array((n % 7) / 7, (n % 2) + (n % 5) / 3, (n % 3) / 3).alias("v"))
    rows = classify.vectors(rows).cache()
    est, grid = classifiers._mlp_points(3)
    named = [{p.name: v for p, v in point.items()} for point in grid]
    assert len({str(sorted(point.items())) for point in named}) == len(grid) == 8
    assert {point["solver"] for point in named} == {"l-bfgs", "gd"}
    assert {point["stepSize"] for point in named if point["solver"] == "gd"} == {0.03, 0.3}

    def weights(**want):
        point = next(g for g, m in zip(grid, named) if all(m.get(k) == v for k, v in want.items()))
        return est.fit(rows, {**point, est.maxIter: 5}).weights.toArray()

    small = [3, 10, 10, 2]
    a, b, c = weights(solver="gd", stepSize=0.03, layers=small), weights(solver="gd", stepSize=0.3, layers=small), weights(solver="l-bfgs", layers=small)
    assert not np.allclose(a, b) and not np.allclose(a, c) and not np.allclose(b, c)
    assert np.allclose(a, weights(solver="gd", stepSize=0.03, layers=small))  # the start is seeded
