"""Tall QR against numpy, sweeps against one regression at a time, edge tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewise.operators import linalg, sweep, tsqr


def _frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts, "id")


def test_condition_of_1e9_keeps_its_digits(spark):
    rng = np.random.RandomState(3)
    u, _ = np.linalg.qr(rng.normal(size=(600, 4)))
    w, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = u @ np.diag([1e9, 1e6, 1e3, 1.0]) @ w.T
    df = _frame(spark, x)
    assert tsqr.condition_number(df, F.col("v"), 4) == pytest.approx(1e9, rel=1e-6)
    assert np.allclose(tsqr.singular_values(df, F.col("v"), 4), [1e9, 1e6, 1e3, 1.0], rtol=1e-6)


def test_edges_of_the_condition(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, 4.0)], "a double, b double")
    cond = tsqr.condition_number(df, tsqr.row_vector(["a", "b"]), 2)
    assert cond == math.inf or cond > 1e15  # one column is twice the other, the row with a null doesn't count
    assert tsqr.condition_number(df.limit(0), tsqr.row_vector(["a", "b"]), 2) is None
    assert tsqr.condition_number(df.filter("a = 1"), tsqr.row_vector(["a", "b"]), 2) == 1.0  # one row, one value
    zero = spark.createDataFrame([(0.0, 0.0)] * 3, "a double, b double")
    got = tsqr.condition_table(spark, {"zero": (zero, tsqr.row_vector(["a", "b"]), 2), "none": (zero.limit(0), tsqr.row_vector(["a"]), 1)})
    assert [tuple(r) for r in got.collect()] == [("zero", 2, math.inf), ("none", 1, None)]


def _moments(x, names):
    return linalg.Moments(list(names), float(len(x)), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))


@pytest.mark.parametrize("terms", [["const", "a", "b", "c"], ["a", "b", "c"], ["c", "const"], ["const"], ["b"]])
def test_sweeps_equal_single_regressions(terms):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(500, 3)) * [1, 10, 1e3] + [5, 100, 1e4]
    y = x @ [1, 0.02, 0.0] + rng.normal(size=500) + 3
    m = _moments(np.column_stack([x, y]), "abcy")
    want, got = linalg.ols(m, terms, "y"), sweep.Regression(m, terms, "y").fit()
    for k in ("coef", "se", "t", "p", "ssr", "r2", "r2_adj", "llf", "aic", "bic", "dof"):
        assert np.allclose(getattr(want, k), getattr(got, k), rtol=1e-8, atol=1e-10), k
    if len(terms) > 1:
        assert dict(sweep.Regression(m, terms).vif()) == pytest.approx(dict(linalg.vif(m, terms)), rel=1e-7)
    fit, trace, dependent = sweep.backward_elimination(m, terms, "y")
    want_fit, want_trace, _ = linalg.backward_elimination(m, terms, "y")
    assert fit.terms == want_fit.terms and dependent == []
    assert [t[0] for t in trace] == [t[0] for t in want_trace]
    assert np.allclose([t[1:] for t in trace], [t[1:] for t in want_trace])


def test_dependent_columns_are_reported():
    rng = np.random.RandomState(2)
    x = rng.normal(size=(300, 3))
    x = np.column_stack([x, 2 * x[:, 0] - x[:, 1], np.full(300, 7.0), x[:, 2] + rng.normal(size=300)])
    m = _moments(x, "abcdky")
    reg = sweep.Regression(m, ["const", *"abcdk"], "y")
    assert "k" in reg.dependent and len(reg.dependent) == 2 and set(reg.dependent) - {"k"} <= set("abd")
    vif = dict(reg.vif())
    assert all(vif[t] == math.inf for t in ["const", "a", "b", "d", "k"]) and vif["c"] == pytest.approx(1.0, abs=0.1)
    kept = [t for t in ["const", *"abcdk"] if t not in reg.dependent]
    assert np.allclose(reg.fit().coef, linalg.ols(m, kept, "y").coef)


def test_a_second_sweep_takes_the_first_back():
    rng = np.random.RandomState(4)
    a = rng.normal(size=(6, 6))
    a = a @ a.T
    assert np.allclose(sweep.swept(sweep.swept(a, 2), 2), a)


def test_projection_is_signed_and_keeps_nulls(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(200, 3)) * [3, 2, 1] + 4
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    m = linalg.moments(df, ["a", "b", "c"])
    holes = df.unionByName(spark.createDataFrame([(1000, 1.0, None, 2.0)], df.schema))
    got = {r["id"]: r for r in linalg.pca_project(holes, m, ["a", "b", "c"], 2, keep=["id"]).collect()}
    assert got[1000]["pc1"] is None and got[1000]["pc2"] is None
    vals, vecs = np.linalg.eigh(np.cov(x.T))
    axes = vecs[:, np.argsort(vals)[::-1]][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    want = (x - x.mean(0)) @ axes
    assert np.allclose([[got[i]["pc1"], got[i]["pc2"]] for i in range(200)], want)
