"""Bucketed rank / running totals / quantiles: force many buckets."""

import numpy as np
from pyspark.sql import functions as F

from scorewise.operators import ordinal, profile


def test_row_index_multi_bucket(spark):
    rng = np.random.RandomState(0)
    keys = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(int(k), int(k) % 3) for k in keys], "k long, g int")
    out = ordinal.with_row_index(df, "k", "idx", rows_per_bucket=300).collect()
    assert all(r["idx"] == r["k"] for r in out)
    grouped = ordinal.with_row_index(df, "k", "idx", group_cols=["g"], rows_per_bucket=300).collect()
    assert all(r["idx"] == r["k"] // 3 for r in grouped)


def test_hot_group_running_sum(spark):
    # one group holds most rows
    rows = [(i, 0 if i % 10 else 1, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    out = ordinal.running_totals(df, ["k"], {"cs": F.col("v")}, group_cols=["g"], rows_per_bucket=200).collect()
    for g in (0, 1):
        vals = sorted((r["k"], r["cs"]) for r in out if r["g"] == g)
        src = [v for k, gg, v in rows if gg == g]
        assert np.allclose([c for _, c in vals], np.cumsum(src))


def test_descending_exclusive(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "s double")
    out = ordinal.running_totals(df, ["s"], {"before": F.lit(1)}, inclusive=False, descending=True, rows_per_bucket=9)
    assert all(r["before"] == 99 - int(r["s"]) for r in out.collect())


def test_sample_every_k(spark):
    df = spark.createDataFrame([(i * 3 + 1,) for i in range(1000)], "ROW_NO long")
    got = sorted(r[0] for r in ordinal.sample_every_k(df, 4).collect())
    assert got == [i * 3 + 1 for i in range(0, 1000, 4)]


def test_exact_quantiles_multi_bucket(spark):
    rng = np.random.RandomState(1)
    vals = rng.normal(size=2001)
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(vals)], "x double, g int")
    from scorewise.operators import ordinal as o

    old = o.DEFAULT_ROWS_PER_BUCKET
    o.DEFAULT_ROWS_PER_BUCKET = 150
    try:
        q = profile.exact_quantiles(df, "x", ["g"], [0.25, 0.5, 0.75]).collect()
    finally:
        o.DEFAULT_ROWS_PER_BUCKET = old
    for r in q:
        sub = vals[np.arange(len(vals)) % 2 == r["g"]]
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.percentile(sub, [25, 50, 75]))


def test_exact_quantiles_heavy_ties(spark):
    # 0/1 flag column: every row ties with half the table
    vals = [float(i % 2) for i in range(999)] + [5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from scorewise.operators import ordinal as o

    old = o.DEFAULT_ROWS_PER_BUCKET
    o.DEFAULT_ROWS_PER_BUCKET = 2
    try:
        r = profile.exact_quantiles(df, "x", [], [0.0, 0.25, 0.5, 0.999, 1.0]).first()
    finally:
        o.DEFAULT_ROWS_PER_BUCKET = old
    assert np.allclose([r["q0"], r["q1"], r["q2"], r["q3"], r["q4"]], np.percentile(vals, [0, 25, 50, 99.9, 100]))
