"""Features picked by name: numeric columns, indicators, nulls, unknown values, clashing prefixes."""

import pytest

from scorewise.operators import encode
from scorewise.operators.encode import indicators
from scorewise.plans import relational
from scorewise.sources.tables import APPLICATION_SCHEMA
from tests.conftest import SF_SMALL


def test_indicators(spark):
    df = spark.createDataFrame([(1, "x", "b c/d"), (2, None, "b"), (3, "y", None)], "n int, k string, k_long string")
    got = df.select("n", *indicators(df, ["n", "k_x", "k_never", "k_long_b c/d"])[1:]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert df.limit(0).select(*indicators(df, ["k_x"])).count() == 0
    with pytest.raises(ValueError):
        indicators(df, ["other_x"])


def test_all_features_and_columns(spark):
    """All 27 features vary in the fixture (income and days aside, both categories of each occur), all 18 columns are there."""
    assert relational.app(spark, SF_SMALL).columns == ["ROW_NO", *APPLICATION_SCHEMA.fieldNames()]
    p = relational.prepared(spark, "/root/testdata/sf0.01")
    rows = p.select(*indicators(p, relational.FEATURES)).toPandas()
    assert rows.shape[1] == 27 and (rows.nunique() >= 2).all()


def test_baskets_of_wide_and_empty_columns(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_LEVELS", 2)  # one-hot columns are bounded, items are not
    df = spark.range(50).selectExpr("id AS ID", "format_string('%02d', id) AS wide", "CAST(NULL AS STRING) AS none", "if(id % 2 = 0, 'a', NULL) AS one")
    got = {r["id"]: r["items"] for r in encode.baskets(df, ["wide", "none", "one"]).collect()}
    assert got == {i: [f"wide_{i:02d}"] if i else [] for i in range(50)}
    assert encode.baskets(df.limit(0), ["wide", "one"]).count() == 0
    known = {r["id"]: r["items"] for r in encode.baskets(df, ["none", "one"], known_levels={"none": [], "one": ["", "a"]}).collect()}
    assert known == {i: [] if i % 2 else ["one_a"] for i in range(50)}
