"""Kernel features are made where they are read: nothing of their size is written, few fits keep them at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorewise.operators import classify
from scorewise.plans import classifiers


@pytest.fixture
def small(spark):
    n = F.col("id")
    rows = spark.range(80).select(
        "id", (n % 2).cast("double").alias("label"),
        F.array((n % 7).cast("double") / 7, (n % 2).cast("double") + (n % 5) / 10, (n % 3).cast("double") / 3).alias("v"),
    )
    train, test = rows.filter("id < 60"), rows.filter("id >= 60")
    return classifiers.ModelData(train, classifiers._balanced(train), classify.vectors(test), ["a", "b", "c"])


def test_no_features_are_written(spark, small, monkeypatch):
    small.splits()
    monkeypatch.setattr(classifiers, "cut_lineage", lambda df: pytest.fail("features were written"))
    monkeypatch.setattr(classify, "k_fold", lambda est, splits: [0.5] * len(splits))
    monkeypatch.setattr(classifiers, "SKETCH", 8)
    assert classifiers.svm_grid(spark, small).count() == 8


def test_fits_side_by_side_are_bounded(spark, small, monkeypatch):
    assert classifiers._fits(14_000, "poly", 27) == 4 and classifiers._fits(850_000, "poly", 27) == 1
    seen = []
    monkeypatch.setattr(classify, "k_fold", lambda est, splits: seen.append(len(splits)) or [0.5] * len(splits))
    monkeypatch.setattr(classifiers, "KEPT", 1)
    assert classifiers.svm_grid(spark, small).count() == 8 and seen == [1] * 40


def test_tuned_svm_scores_rows_without_key(spark, small, monkeypatch):
    """The test rows of the model table have no ``key``; the sketch of the polynomial kernel asked for it."""
    monkeypatch.setattr(classifiers, "SKETCH", 8)
    monkeypatch.setattr(classifiers, "svm_grid", lambda *a: None)
    monkeypatch.setattr(classifiers, "_best", lambda table: 7)
    assert "key" not in small.test.columns
    row = classifiers._tuned_svm(spark, small).first()
    assert row["model"] == "svm_after_grid" and 0 <= row["accuracy"] <= 1
