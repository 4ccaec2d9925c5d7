"""Grids, ensembles and the leaderboard have the reference's sizes; only this test passes small ones."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import functions as F

from scorewise.operators import classify, ensemble
from scorewise.plans import classifiers


def _values(grid):
    out = {}
    for point in grid:
        for p, v in point.items():
            out.setdefault(p.name, set()).add(v)
    return out


def test_sizes(spark):
    def sizes(fn):
        found = inspect.signature(fn).parameters
        return {k: found[k].default for k in ("n_bags", "rounds", "trees", "depth") if k in found}

    assert sizes(ensemble.bagging) == {"n_bags": 100, "trees": 100, "depth": 30}
    assert sizes(ensemble.adaboost) == {"rounds": 100, "trees": 100, "depth": 30}
    assert sizes(ensemble.stacking) == {"trees": 100, "depth": 30}
    grid = classifiers._dt_points()[1]
    assert len(grid) == 6 and _values(grid)["maxDepth"] == {2, 8, 10}
    grid = classifiers._rf_points()[1]
    assert len(grid) == 16
    assert _values(grid) == {"maxDepth": {3, 5}, "numTrees": {100, 200}, "featureSubsetStrategy": {"1", "3"}, "minInstancesPerNode": {1, 3}}


def test_queries_pass_no_sizes(spark, monkeypatch):
    seen = []
    for name in ("bagging", "adaboost", "stacking"):
        monkeypatch.setattr(ensemble, name, lambda *a, **k: seen.append(set(k)))
    monkeypatch.setattr(classify, "metrics_row", lambda *a: None)
    d = classifiers.ModelData.__new__(classifiers.ModelData)
    d.train = d.test = None
    d._splits = {classifiers.CV_FOLDS: []}
    for fn in (classifiers.bagging_rf, classifiers.adaboost_rf, classifiers.stacking_rf):
        fn(spark, d)
    assert seen == [{"seed"}] * 3


def test_leaderboard_has_all_rows(spark, monkeypatch):
    """All 18 rows are fitted and scored; the searches (their best point) and the metrics are stand-ins, for time."""
    n = F.col("id")
    rows = spark.range(0, 60, 1, 1).select(
        "id", (n % 2).cast("double").alias("label"),
        F.array((n % 7).cast("double") / 7, (n % 2).cast("double") + (n % 5) / 3, (n % 3).cast("double") / 3).alias("v"),
    )
    rows = rows.select(n.alias("key"), "id", "label", "v")
    train, test = classify.vectors(rows.filter("id < 40")).cache(), classify.vectors(rows.filter("id >= 40")).cache()
    d = classifiers.ModelData(train, train, test, ["a", "b", "c"])
    d.splits = lambda folds=2: [(train, test), (test, train)]
    monkeypatch.setattr(ensemble, "bagging", functools.partial(ensemble.bagging, n_bags=3, trees=2, depth=3, checkpoint_every=2))
    monkeypatch.setattr(ensemble, "adaboost", functools.partial(ensemble.adaboost, rounds=2, trees=2, depth=1))
    monkeypatch.setattr(ensemble, "stacking", functools.partial(ensemble.stacking, trees=2, depth=3))
    for module, name in ((classify, "grid_search"), (classifiers, "svm_grid"), (classifiers, "gaussian_nb_grid"), (classifiers, "knn_grid")):
        monkeypatch.setattr(module, name, lambda *a: None)
    monkeypatch.setattr(classifiers, "_best", lambda table: 0)

    def brief(pred, name):
        scored = classify.positive_score(pred)
        hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        return scored.agg(F.lit(name).alias("model"), F.count("score").alias("n"), hit.alias("accuracy"))

    monkeypatch.setattr(classify, "metrics_row", brief)
    got = classifiers.model_leaderboard(spark, d).collect()
    assert len(got) == len({r["model"] for r in got}) == 18
    assert all(r["n"] == 20 and 0 <= r["accuracy"] <= 1 for r in got)
