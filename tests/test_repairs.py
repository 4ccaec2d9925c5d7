"""Null keys, class sizes and stop rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorewise.operators import bayes, ensemble, evaluate, linalg, neighbors, ordinal, profile, resample


def _rows(spark):
    return spark.createDataFrame(
        [(i, None if i % 10 == 0 else float(i % 37), None if i % 4 == 0 else i % 3, i % 2) for i in range(200)],
        "id long, x double, g int, label int",
    )


@pytest.mark.parametrize("rows_per_bucket", [None, 7])
def test_positions_keep_null_keys(spark, rows_per_bucket):
    df = _rows(spark)
    got = ordinal.with_row_index(df, ["x", "id"], "pos", group_cols=["g"], rows_per_bucket=rows_per_bucket).collect()
    assert len(got) == 200
    for g in (None, 0, 1, 2):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"] is not None, r["x"] or 0, r["id"]))
        assert [r["pos"] for r in mine] == list(range(len(mine)))


def test_area_is_the_same_in_many_buckets(spark, monkeypatch):
    df = _rows(spark)
    one = evaluate.auc(df, "label", "x").first()["auc"]
    monkeypatch.setattr(ordinal, "DEFAULT_ROWS_PER_BUCKET", 3)
    assert evaluate.auc(df, "label", "x").first()["auc"] == pytest.approx(one)


def test_scored_metrics_agree_with_the_single_ones(spark):
    df = _rows(spark).select(F.col("label").cast("double").alias("label"), F.col("x").alias("score"), (F.col("id") % 3 == 0).cast("double").alias("prediction"))
    got = evaluate.scored_metrics(df).first().asDict()
    want = evaluate.binary_metrics(df, scale=None).first().asDict() | evaluate.auc(df).first().asDict()
    assert got == pytest.approx(want)


@pytest.mark.parametrize("few, many", [(80, 100), (1, 20), (20, 20), (3, 50), (49, 100)])
def test_smote_balances(spark, few, many):
    rows = [(i, 0, [float(i), 1.0]) for i in range(few)] + [(1000 + i, 1, [float(i), 5.0]) for i in range(many)]
    out = resample.smote(spark.createDataFrame(rows, "id long, label int, v array<double>"), k=5).collect()
    assert sum(r["label"] == 0 for r in out) == sum(r["label"] == 1 for r in out) == max(few, many)
    made = [r for r in out if r["synthetic"]]
    assert len({r["copy"] for r in made}) == len(made) and all(r["copy"] >= 0 for r in made)
    if few == 1:
        assert all(r["v"] == [0.0, 1.0] and r["neighbor_id"] == 0 for r in made)


def test_smote_uses_each_class_own_neighbours(spark):
    rows = [(i, 0, [float(i)]) for i in range(2)] + [(100 + i, 1, [float(i)]) for i in range(12)] + [(200 + i, 2, [float(i)]) for i in range(30)]
    out = resample.smote(spark.createDataFrame(rows, "id long, label int, v array<double>"), k=5).collect()
    assert {k: sum(r["label"] == k for r in out) for k in (0, 1, 2)} == {0: 30, 1: 30, 2: 30}
    assert len({r["neighbor_id"] - r["id"] for r in out if r["synthetic"] and r["label"] == 1}) > 2


def test_nulls_leave_the_prior_alone(spark):
    rows = [(0.0, None if i < 4 else float(i), 1.0) for i in range(6)] + [(1.0, float(i), 2.0 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    params = bayes.fit_params(df, "label", ["a", "b"])
    assert {(r["label"], round(r["prior"], 6)) for r in params.collect()} == {(0.0, 0.6), (1.0, 0.4)}
    got = bayes.predict(df, bayes.fit_params(df, "label", ["a", "b"], 1e-2), ["a", "b"]).collect()
    assert all(r["prediction"] is not None for r in got)


def test_boosting_stops_at_guessing(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 10 < 3) if i % 2 else float(i % 10 >= 3), 1.0) for i in range(100)], "label double, p double, w double")
    miss = df.filter("label <> p").count() / 100
    assert miss >= 0.5
    same, alpha = ensemble.samme_reweight(df, "label", "p", "w")
    assert alpha == -float("inf") and same.agg(F.sum("w")).first()[0] == 100.0


def test_many_equal_vectors(spark):
    n = 3000
    df = spark.range(n).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = neighbors.knn_join(df, df, 3, "id", "v", exclude_self=True)
    assert got.count() == 3 * n and got.agg(F.max("distance")).first()[0] == 0.0


@pytest.mark.parametrize("parts", [3, 100])
def test_moments_read_their_input_once(spark, parts):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(4000, numPartitions=parts).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).mapInPandas(tell, "a double, b double")
    assert linalg.moments(df, ["a", "b"]).n == 4000 and seen.value == 4000
    profile.pairwise(df, ["a", "b"]).collect()
    assert seen.value == 8000
