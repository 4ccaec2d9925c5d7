"""Every registered query with an oracle: Spark vs DuckDB on the same views."""

import pytest

import __spark_entry__ as ent
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck_con

ORACLES = ent.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = ent.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    msg = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns == ["NAME_INCOME_TYPE", "n", "n_good", "good_rate"]


def test_known_fixture_counts(spark):
    from scorewise.plans import relational

    p = relational.prepared(spark, "/root/testdata/sf0.01")
    counts = {r["response"]: r["count"] for r in p.groupBy("response").count().collect()}
    assert counts == {0.0: 111, 1.0: 889}
