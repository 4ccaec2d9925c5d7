"""The skew-safe preparation order equals the reference's order (pandas brute force)."""

import numpy as np
import pandas as pd

from scorewise.operators import clean


def _reference_prepare(app: pd.DataFrame, cr: pd.DataFrame) -> pd.DataFrame:
    app = app.sort_values("ROW_NO")
    cr = cr.sort_values("ROW_NO")
    app = app[app.ID.isin(cr.ID)]
    cr = cr[cr.ID.isin(app.ID)]
    counts = app.OCCUPATION_TYPE.value_counts()
    top = counts[counts == counts.max()].index.min()
    app = app.assign(OCCUPATION_TYPE=app.OCCUPATION_TYPE.fillna(top))
    app = app.drop_duplicates("ID")
    cr = cr.drop_duplicates("ID").drop(columns=["ROW_NO"])
    return app.merge(cr, on="ID", how="inner")


def test_hot_applicant_matches_reference(spark):
    rng = np.random.RandomState(3)
    n = 3000
    ids = rng.randint(0, 400, size=n)
    ids[: n // 3] = 7  # one applicant holds a third of all rows
    occ = np.where(rng.uniform(size=n) < 0.2, None, rng.choice(["a", "b", "c"], size=n))
    app = pd.DataFrame({"ROW_NO": rng.permutation(n).astype("int64"), "ID": ids.astype("int64"),
                        "OCCUPATION_TYPE": occ, "X": rng.normal(size=n)})
    m = 5000
    cids = rng.randint(0, 500, size=m)
    cids[: m // 3] = 7
    cr = pd.DataFrame({"ROW_NO": rng.permutation(m).astype("int64"), "ID": cids.astype("int64"),
                       "MONTHS_BALANCE": rng.randint(-60, 0, size=m).astype("int32"),
                       "STATUS": rng.choice(list("XC012345"), size=m)})
    want = _reference_prepare(app, cr).sort_values("ID").reset_index(drop=True)
    got = clean.joined_applicants(
        spark.createDataFrame(app.astype(object).where(app.notna(), None)).repartition(7),
        spark.createDataFrame(cr).repartition(5),
    ).toPandas().sort_values("ID").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in want.columns:
        if c == "X":
            assert np.allclose(got[c].astype(float), want[c].astype(float))
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
