"""The polynomial kernel: its degree, its grid points and their folds, on a small model table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorewise.operators import classify
from scorewise.plans import classifiers


@pytest.fixture
def small(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(80).select(
        "id", (n % 2).cast("double").alias("label"),
        F.array((n % 7).cast("double") / 7, (n % 2).cast("double") + (n % 5) / 10, (n % 3).cast("double") / 3).alias("v"),
    )
    train, test = rows.filter("id < 60"), rows.filter("id >= 60")
    d = classifiers.ModelData(train, classifiers._balanced(train), classify.vectors(test), ["a", "b", "c"])
    monkeypatch.setattr(classifiers, "model_data", lambda spark, sf: d)
    return d


def test_poly_svm_has_degree_three(spark, small, monkeypatch):
    seen = []
    fit_score = classify.fit_score

    def spy(est, train, test, name):
        seen.append(len(train.first()["poly"]))
        return fit_score(est, train, test, name)

    monkeypatch.setattr(classify, "fit_score", spy)
    assert classifiers.poly_svm(spark, "").count() == 1
    assert seen == [19]  # monomials of degrees one to three in three features


def test_svm_grid_has_all_points(spark, small, monkeypatch):
    seen = []

    def spy(est, splits):
        seen.append((len(splits), len(splits[0][0].first()["features"])))
        return [0.5] * len(splits)

    monkeypatch.setattr(classify, "k_fold", spy)
    got = [r["params"] for r in classifiers.svm_grid(spark, "").orderBy("point").collect()]
    assert got == [f"kernel={k}, gamma={g}, C={c}" for k in ("rbf", "poly") for g in (1.0, 0.001) for c in (0.1, 10.0)]
    assert seen == [(5, 200)] * 4 + [(5, 19)] * 4
