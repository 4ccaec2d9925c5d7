"""Registered queries: encoding, linear algebra, regression, evaluation, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even, safe_ratio, split_bucket, split_bucket_sql
from scorewise.operators import encode, evaluate, linalg, mine, ordinal, resample, sweep, tsqr
from scorewise.plans.duck import PREP_CTE, with_fx
from scorewise.plans.registry import query
from scorewise.plans.relational import fx_reg, prepared
from scorewise.sources.fixtures import (
    APP_COLUMNS,
    EDUCATION_TYPES,
    FAMILY_STATUSES,
    HOUSING_TYPES,
    INCOME_TYPES,
    OCCUPATIONS,
    fixture,
)
from scorewise.session import cut_lineage

ENCODED = {
    "CODE_GENDER": ["F", "M"],
    "FLAG_OWN_CAR": ["N", "Y"],
    "FLAG_OWN_REALTY": ["N", "Y"],
    "NAME_INCOME_TYPE": INCOME_TYPES,
    "NAME_EDUCATION_TYPE": EDUCATION_TYPES,
    "NAME_FAMILY_STATUS": FAMILY_STATUSES,
    "NAME_HOUSING_TYPE": HOUSING_TYPES,
    "OCCUPATION_TYPE": OCCUPATIONS,
}
PLAIN = [*(c for c in APP_COLUMNS if c not in ENCODED), "MONTHS_BALANCE", "STATUS", "response"]
STD_COLS = ["AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "MONTHS_BALANCE"]
REG_SEED = 5808


def _one_hot_sql() -> str:
    dummies = []
    for c, lv in ENCODED.items():
        for v in lv[1:]:
            dummies.append(f'CAST(CASE WHEN {c} = \'{v}\' THEN 1 ELSE 0 END AS INTEGER) AS "{c}_{v}"')
    return PREP_CTE + f"\nSELECT {', '.join(PLAIN)}, {', '.join(dummies)} FROM prepared"


def encoded(spark, sf):
    return encode.one_hot(prepared(spark, sf), list(ENCODED))


@query("one_hot", _one_hot_sql())
def one_hot(spark, sf):
    return encoded(spark, sf)


@query(
    "standardize",
    PREP_CTE
    + ",\ns AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STD_COLS)
    + " FROM prepared)\nSELECT ID, "
    + ", ".join(f"round_even(({c} - m_{c}) / s_{c}, 2) AS {c}" for c in STD_COLS)
    + ", response FROM prepared, s",
)
def standardize(spark, sf):
    return encode.standardize(prepared(spark, sf).select("ID", *STD_COLS, "response"), STD_COLS, 2)


# --------------------------------------------------------------------------- A17-based: PCA, SVD, VIF, cond

def _eig2(a: str, b: str, c: str) -> tuple[str, str]:
    """Closed-form eigenvalues (larger, smaller) of [[a, b], [b, c]]."""
    root = f"sqrt((({a}) - ({c})) * (({a}) - ({c})) / 4 + ({b}) * ({b}))"
    return f"((({a}) + ({c})) / 2 + {root})", f"((({a}) + ({c})) / 2 - {root})"


_L1, _L2 = _eig2("a", "c", "b")
_PCA2 = (
    with_fx("fx_reg")
    + f""",
m AS (SELECT var_samp(x1) AS a, var_samp(x2) AS b, covar_samp(x1, x2) AS c FROM fx_reg),
e AS (SELECT {_L1} AS l1, {_L2} AS l2, a + b AS tot FROM m),
t AS (SELECT 1 AS component, l1 AS ev, l1 / tot AS ratio, l1 / tot AS cum FROM e
      UNION ALL SELECT 2, l2, l2 / tot, (l1 + l2) / tot FROM e)"""
)


def _pca_fx(spark, sf):
    reg = fx_reg(spark, sf)
    m = linalg.moments(reg, ["x1", "x2"])
    return linalg.pca_table(spark, m, ["x1", "x2"])


@query(
    "pca_explained_variance",
    _PCA2 + "\nSELECT component, round_even(ev, 6) AS explained_variance, round_even(ratio, 6) AS ratio, "
    "round_even(cum, 6) AS cumulative FROM t",
)
def pca_explained_variance(spark, sf):
    return _pca_fx(spark, sf)


@query("cumulative_variance", _PCA2 + "\nSELECT component, round_even(cum, 6) AS cumulative FROM t")
def cumulative_variance(spark, sf):
    return _pca_fx(spark, sf).select("component", "cumulative")


@query(
    "components_for_90pct",
    _PCA2 + "\nSELECT min(CASE WHEN round_even(cum, 6) >= 0.9 THEN component END) AS n_components FROM t",
)
def components_for_90pct(spark, sf):
    return linalg.components_for(_pca_fx(spark, sf), 0.9)


def _model_matrix(spark, sf):
    """Encoded applicant features (dummies + numeric), the matrix the reference analyses."""
    enc = encoded(spark, sf)
    feats = [c for c in enc.columns if c not in ("ROW_NO", "ID", "STATUS", "response", "CNT_CHILDREN", "FLAG_MOBIL", "DAYS_BIRTH")]
    return enc, feats


@query("pca_project")
def pca_project(spark, sf):
    enc, feats = _model_matrix(spark, sf)
    m = linalg.moments(enc, feats)
    table = linalg.pca_table(spark, m, feats)
    k = components_for_value(table)
    return linalg.pca_project(enc, m, feats, k, keep=["ID"])


def components_for_value(table) -> int:
    row = linalg.components_for(table, 0.9).first()
    return int(row["n_components"] or table.count())


_G1, _G2 = _eig2("g11", "g12", "g22")


@query(
    "condition_number",
    with_fx("fx_reg")
    + f""",
g AS (SELECT sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22 FROM fx_reg)
SELECT round_even(sqrt({_G1} / {_G2}), 3) AS condition_number FROM g""",
)
def condition_number(spark, sf):
    cond = tsqr.condition_number(fx_reg(spark, sf), tsqr.row_vector(["x1", "x2"]), 2)
    return spark.createDataFrame([(cond,)], "condition_number DOUBLE").select(
        round_even("condition_number", 3).alias("condition_number")
    )


@query("condition_numbers")
def condition_numbers(spark, sf):
    """Condition of the feature matrix, its PCA output, the balanced matrix and that one's SVD output."""
    enc, feats = _model_matrix(spark, sf)
    rows = enc.na.drop(subset=["response", *feats])
    rows = cut_lineage(rows.select(F.col("ID").alias("id"), F.col("response").alias("label"), tsqr.row_vector(feats).alias("v")))
    # the interpolated vectors are made once, not once for each column
    balanced = cut_lineage(resample.smote(rows, seed=REG_SEED).select("v"))

    def unpacked(df):
        return df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(feats)])

    m, mb = linalg.moments(unpacked(rows), feats), linalg.moments(unpacked(balanced), feats)
    pca = linalg.pca_project(unpacked(rows), m, feats, components_for_value(linalg.pca_table(spark, m, feats)))
    svd = linalg.svd_project(unpacked(balanced), mb, feats, _svd_k(spark, mb, feats))
    return tsqr.condition_table(
        spark,
        {
            "features": (rows, F.col("v"), len(feats)),
            "pca": (pca, tsqr.row_vector(pca.columns), len(pca.columns)),
            "smote": (balanced, F.col("v"), len(feats)),
            "svd": (svd, tsqr.row_vector(svd.columns), len(svd.columns)),
        },
    )


@query(
    "svd_explained_variance",
    with_fx("fx_reg")
    + f""",
g AS (SELECT sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22,
             var_pop(x1) AS s11, covar_pop(x1, x2) AS s12, var_pop(x2) AS s22 FROM fx_reg),
v AS (SELECT *, g12 AS v1, {_G1} - g11 AS v2 FROM g),
u AS (SELECT *, v1 / sqrt(v1 * v1 + v2 * v2) AS u1, v2 / sqrt(v1 * v1 + v2 * v2) AS u2 FROM v),
r AS (SELECT u1 * u1 * s11 + 2 * u1 * u2 * s12 + u2 * u2 * s22 AS ev, s11 + s22 AS tot FROM u)
SELECT 1 AS component, round_even(ev, 6) AS explained_variance, round_even(ev / tot, 6) AS ratio,
       round_even(ev / tot, 6) AS cumulative FROM r""",
)
def svd_explained_variance(spark, sf):
    m = linalg.moments(fx_reg(spark, sf), ["x1", "x2"])
    return linalg.svd_table(spark, m, ["x1", "x2"])


def _svd_k(spark, m, feats):
    table = linalg.svd_table(spark, m, feats)
    return components_for_value(table)


@query("svd_project")
def svd_project(spark, sf):
    enc, feats = _model_matrix(spark, sf)
    m = linalg.moments(enc, feats)
    return linalg.svd_project(enc, m, feats, _svd_k(spark, m, feats), keep=["ID"])


@query("svd_top_loading")
def svd_top_loading(spark, sf):
    enc, feats = _model_matrix(spark, sf)
    m = linalg.moments(enc, feats)
    return linalg.svd_top_loading(spark, m, feats, _svd_k(spark, m, feats))


_VIF_SQL = (
    with_fx("fx_reg")
    + """,
s AS (SELECT count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12,
             sum(x2 * x2) AS g22, corr(x1, x2) AS r FROM fx_reg),
c AS (SELECT n, (s1 * (g22 * s1 - g12 * s2) + s2 * (g11 * s2 - g12 * s1)) / (g11 * g22 - g12 * g12) AS fitted, r FROM s),
v AS (SELECT 'const' AS feature, n / (n - fitted) AS vif FROM c
      UNION ALL SELECT 'x1', 1 / (1 - r * r) FROM c
      UNION ALL SELECT 'x2', 1 / (1 - r * r) FROM c)"""
)


def _vif_fx(spark, sf):
    m = linalg.moments(fx_reg(spark, sf), ["x1", "x2"])
    return sweep.vif_table(spark, m, [linalg.CONST, "x1", "x2"])


@query("vif", _VIF_SQL + "\nSELECT feature, round_even(vif, 6) AS vif FROM v")
def vif(spark, sf):
    return _vif_fx(spark, sf)


#: Inverse of the correlation matrix by cofactors; z is mean over population deviation.
_VIF3_SQL = (
    with_fx("fx_collinear")
    + """,
s AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c,
             avg(x1) / stddev_pop(x1) AS z1, avg(x2) / stddev_pop(x2) AS z2, avg(x3) / stddev_pop(x3) AS z3 FROM fx_collinear),
d AS (SELECT *, 1 - a * a - b * b - c * c + 2 * a * b * c AS det FROM s),
v AS (SELECT 'x1' AS feature, (1 - c * c) / det AS vif FROM d
      UNION ALL SELECT 'x2', (1 - b * b) / det FROM d
      UNION ALL SELECT 'x3', (1 - a * a) / det FROM d
      UNION ALL SELECT 'const', 1 + (z1 * z1 * (1 - c * c) + z2 * z2 * (1 - b * b) + z3 * z3 * (1 - a * a)
        + 2 * z1 * z2 * (b * c - a) + 2 * z1 * z3 * (a * c - b) + 2 * z2 * z3 * (a * b - c)) / det FROM d)"""
)


@query("vif_high", _VIF3_SQL + "\nSELECT feature AS high_vif, round_even(vif, 2) AS vif FROM v WHERE vif > 10")
def vif_high(spark, sf):
    m = linalg.moments(fixture(spark, sf, "fx_collinear"), ["x1", "x2", "x3"])
    out = sweep.vif_table(spark, m, [linalg.CONST, "x1", "x2", "x3"]).filter(F.col("vif") > 10)
    return out.select(F.col("feature").alias("high_vif"), round_even("vif", 2).alias("vif"))


# --------------------------------------------------------------------------- R: regression

def _train_test(df, seed=REG_SEED, id_col="id"):
    b = split_bucket(id_col, seed)
    return df.filter(b >= 20), df.filter(b < 20)


_TRAIN = f"{split_bucket_sql('id', REG_SEED)} >= 20"
_TEST = f"{split_bucket_sql('id', REG_SEED)} < 20"

_OLS1 = (
    with_fx("fx_reg")
    + f""",
tr AS (SELECT * FROM fx_reg WHERE {_TRAIN}),
f AS (SELECT CAST(regr_count(y, x1) AS DOUBLE) AS n, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0, regr_r2(y, x1) AS r2,
             regr_syy(y, x1) AS syy FROM tr),
g AS (SELECT *, (1 - r2) * syy AS ssr FROM f),
h AS (SELECT *, -n / 2 * (ln(2 * pi() * ssr / n) + 1) AS llf FROM g)"""
)


def _ols1(spark, sf):
    train, _ = _train_test(fx_reg(spark, sf))
    m = linalg.moments(train, ["x1", "y"])
    return linalg.ols(m, [linalg.CONST, "x1"], "y")


@query(
    "ols_fit",
    _OLS1
    + """
SELECT CAST(n AS BIGINT) AS n, round_even(b0, 6) AS intercept, round_even(b1, 6) AS slope, round_even(r2, 6) AS r2,
       round_even(1 - (n - 1) / (n - 2) * (1 - r2), 6) AS r2_adj,
       round_even(-2 * llf + 4, 3) AS aic, round_even(-2 * llf + 2 * ln(n), 3) AS bic FROM h""",
)
def ols_fit(spark, sf):
    fit = _ols1(spark, sf)
    row = (int(fit.n), float(fit.coef[0]), float(fit.coef[1]), float(fit.r2), float(fit.r2_adj), float(fit.aic), float(fit.bic))
    df = spark.createDataFrame([row], "n BIGINT, intercept DOUBLE, slope DOUBLE, r2 DOUBLE, r2_adj DOUBLE, aic DOUBLE, bic DOUBLE")
    return df.select(
        "n", *[round_even(c, 6).alias(c) for c in ["intercept", "slope", "r2", "r2_adj"]],
        round_even("aic", 3).alias("aic"), round_even("bic", 3).alias("bic"),
    )


@query(
    "ols_predict",
    _OLS1 + f"\nSELECT id, round_even(b0 + b1 * x1, 6) AS prediction FROM fx_reg, h WHERE {_TEST}",
)
def ols_predict(spark, sf):
    fit = _ols1(spark, sf)
    _, test = _train_test(fx_reg(spark, sf))
    return linalg.ols_predict(test.select("id", "x1"), fit).select("id", round_even("prediction", 6).alias("prediction"))


@query(
    "regression_metrics",
    _OLS1
    + f""",
p AS (SELECT avg((y - (b0 + b1 * x1)) * (y - (b0 + b1 * x1))) AS mse FROM fx_reg, h WHERE {_TEST})
SELECT round_even(mse, 3) AS mse, round_even(r2, 3) AS r2, round_even(1 - (n - 1) / (n - 2) * (1 - r2), 3) AS r2_adj,
       round_even(-2 * llf + 4, 3) AS aic, round_even(-2 * llf + 2 * ln(n), 3) AS bic FROM h, p""",
)
def regression_metrics(spark, sf):
    fit = _ols1(spark, sf)
    _, test = _train_test(fx_reg(spark, sf))
    mse = linalg.ols_predict(test, fit).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse"))
    stats = spark.createDataFrame([(float(fit.r2), float(fit.r2_adj), float(fit.aic), float(fit.bic))], "r2 DOUBLE, r2_adj DOUBLE, aic DOUBLE, bic DOUBLE")
    return mse.crossJoin(stats).select(*[round_even(c, 3).alias(c) for c in ["mse", "r2", "r2_adj", "aic", "bic"]])


@query(
    "regression_series",
    _OLS1
    + f""",
s AS (SELECT 'train' AS series, id, y AS value FROM fx_reg WHERE {_TRAIN}
      UNION ALL SELECT 'test', id, y FROM fx_reg WHERE {_TEST}
      UNION ALL SELECT 'predicted', id, b0 + b1 * x1 FROM fx_reg, h WHERE {_TEST})
SELECT series, row_number() OVER (PARTITION BY series ORDER BY id) - 1 AS pos, round_even(value, 6) AS value FROM s""",
)
def regression_series(spark, sf):
    fit = _ols1(spark, sf)
    train, test = _train_test(fx_reg(spark, sf))
    pred = linalg.ols_predict(test, fit)
    s = (
        train.select(F.lit("train").alias("series"), "id", F.col("y").alias("value"))
        .unionByName(test.select(F.lit("test").alias("series"), "id", F.col("y").alias("value")))
        .unionByName(pred.select(F.lit("predicted").alias("series"), "id", F.col("prediction").alias("value")))
    )
    s = ordinal.with_row_index(s, "id", "pos", group_cols=["series"])
    return s.select("series", "pos", round_even("value", 6).alias("value"))


_TERMS = [linalg.CONST, "x1", "x2", "x3"]
P_MAX = 0.01


def _backward(spark, sf):
    train, _ = _train_test(fx_reg(spark, sf))
    m = linalg.moments(train, ["x1", "x2", "x3", "y"])
    return sweep.backward_elimination(m, _TERMS, "y", p_max=P_MAX)


def _sweep_sql(m: str, k: str) -> str:
    """Sweep of the 5 x 5 matrix ``m`` (a list, row by row) at row ``k``, both counted from 0."""

    def at(i: str, j: str) -> str:
        return f"{m}[({i}) * 5 + ({j}) + 1]"

    i, j, d = "(e // 5)", "(e % 5)", at(k, k)
    return f"""list_transform(range(25), lambda e: CASE
      WHEN {i} = {k} AND {j} = {k} THEN 1 / {d} WHEN {i} = {k} THEN {at(i, j)} / {d} WHEN {j} = {k} THEN -{at(i, j)} / {d}
      ELSE {at(i, j)} - {at(i, k)} * {at(k, j)} / {d} END)"""


def _simpson_sql(low: str, high: str) -> str:
    """Integral of cos(t)^(dof - 1) over [low, high] by 2,000 Simpson steps, without the constant."""
    t = f"({low}) + (({high}) - ({low})) * i / 2000"
    return f"((({high}) - ({low})) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos({t}), dof - 1))))"


_TOP = "least(pi() / 2, 40 / sqrt(dof))"  # beyond it the integrand is below 1e-300

#: Student's two-sided tail of sqrt(t2): with t = sqrt(dof) tan(u) the density is cos(u)^(dof - 1).
_TAIL = f"CASE WHEN atan(sqrt(t2 / dof)) >= {_TOP} THEN 0.0 ELSE {_simpson_sql('atan(sqrt(t2 / dof))', _TOP)} / {_simpson_sql('0.0', _TOP)} END"


def _elimination_sql() -> str:
    """One row per step: the matrix with the active terms swept, its statistics and the weakest term."""
    names = ["x1", "x2", "x3", "y"]
    sums = [f"avg({a}) AS m{i}" for i, a in enumerate(names)]
    sums += [f"covar_pop({a}, {b}) * count(*) AS c{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    cells = ["1 / n", *[f"m{j}" for j in range(4)]]
    for i in range(4):
        cells += [f"-m{i}", *[f"c{min(i, j)}{max(i, j)}" for j in range(4)]]
    stats = """SELECT *, n - len(act) AS dof, a[25] AS ssr,
        list_transform(act, lambda k: a[k * 5 + 5] * a[k * 5 + 5] / (a[25] / (n - len(act)) * a[k * 6 + 1])) AS t2s"""
    weakest = "SELECT *, list_min(t2s) AS t2, act[list_position(t2s, list_min(t2s))] AS worst"
    with_p = f"SELECT *, {_TAIL} AS p"

    def measured(src: str) -> str:
        return f"{with_p} FROM ({weakest} FROM ({stats} FROM ({src})))"

    first = f"SELECT 0 AS step, n, yty, c33 AS sst, {_sweep_sql('a2', '3')} AS a, [0, 1, 2, 3] AS act FROM (SELECT *, {_sweep_sql('a1', '2')} AS a2 FROM (SELECT *, {_sweep_sql('a0', '1')} AS a1 FROM start))"
    after = f"SELECT step + 1 AS step, n, yty, sst, {_sweep_sql('a', 'worst')} AS a, list_filter(act, lambda k: k <> worst) AS act FROM steps WHERE p >= {P_MAX}"
    return (
        with_fx("fx_reg").replace("WITH ", "WITH RECURSIVE ", 1)
        + f""",
g AS (SELECT CAST(count(*) AS DOUBLE) AS n, {", ".join(sums)} FROM fx_reg WHERE {_TRAIN}),
start AS (SELECT n, c33, c33 + n * m3 * m3 AS yty, [{", ".join(cells)}] AS a0 FROM g),
steps AS ({measured(first)}
  UNION ALL
  {measured(after)}),
named AS (SELECT *, CASE WHEN list_contains(act, 0) THEN 1 - ssr / sst ELSE 1 - ssr / yty END AS r2,
                 CASE WHEN list_contains(act, 0) THEN 1 ELSE 0 END AS k0, -n / 2 * (ln(2 * pi() * ssr / n) + 1) AS llf FROM steps),
last AS (SELECT n, dof, unnest(act) AS k, a, ssr FROM named WHERE p < {P_MAX}),
coefs AS (SELECT ['const', 'x1', 'x2', 'x3'][k + 1] AS term, a[k * 5 + 5] AS coef, sqrt(ssr / dof * a[k * 6 + 1]) AS se, dof FROM last)"""
    )


_ELIMINATION = _elimination_sql()


@query(
    "ols_backward",
    _ELIMINATION
    + f""",
tested AS (SELECT *, coef / se * (coef / se) AS t2 FROM coefs)
SELECT term, round_even(coef, 6) AS coef, round_even(se, 6) AS std_err, round_even(coef / se, 6) AS t, round_even({_TAIL}, 6) AS p_value FROM tested""",
)
def ols_backward(spark, sf):
    fit, _, _ = _backward(spark, sf)
    return linalg.ols_coef_table(spark, fit)


@query(
    "ols_trace",
    _ELIMINATION
    + f"""
SELECT ['const', 'x1', 'x2', 'x3'][worst + 1] AS removed, round_even(-2 * llf + 2 * len(act), 3) AS aic,
       round_even(-2 * llf + ln(n) * len(act), 3) AS bic, round_even(1 - (n - k0) / dof * (1 - r2), 3) AS r2_adj,
       round_even(p, 3) AS p_value, round_even(r2, 3) AS r2 FROM named WHERE p >= {P_MAX}""",
)
def ols_trace(spark, sf):
    _, trace, _ = _backward(spark, sf)
    rows = [(f, float(a), float(b), float(r2a), float(p), float(r2)) for f, a, b, r2a, p, r2 in trace]
    df = spark.createDataFrame(rows, "removed STRING, aic DOUBLE, bic DOUBLE, r2_adj DOUBLE, p_value DOUBLE, r2 DOUBLE")
    return df.select("removed", *[round_even(c, 3).alias(c) for c in ["aic", "bic", "r2_adj", "p_value", "r2"]])


_Z = "1.959963984540054"


@query(
    "ols_conf_int",
    _ELIMINATION
    + f""",
q AS (SELECT *, {_Z} + (pow({_Z}, 3) + {_Z}) / (4 * dof) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96 * dof * dof)
             + (3 * pow({_Z}, 7) + 19 * pow({_Z}, 5) + 17 * pow({_Z}, 3) - 15 * {_Z}) / (384 * pow(dof, 3)) AS q FROM coefs)
SELECT term, round_even(coef - q * se, 3) AS lower, round_even(coef + q * se, 3) AS upper FROM q""",
)
def ols_conf_int(spark, sf):
    fit, _, _ = _backward(spark, sf)
    return linalg.ols_conf_int(spark, fit)


@query("ols_employment_ratio")
def ols_employment_ratio(spark, sf):
    """The reference's regression: employment / income ratio on the other features."""
    enc, feats = _model_matrix(spark, sf)
    df = enc.withColumn("employment_to_income", safe_ratio("DAYS_EMPLOYED", "AMT_INCOME_TOTAL")).filter(
        F.col("employment_to_income").isNotNull()
    )
    xs = [c for c in feats if c not in ("AMT_INCOME_TOTAL", "DAYS_EMPLOYED")]
    train = df.filter(split_bucket("ID", REG_SEED) >= 20)
    m = linalg.moments(train, xs + ["employment_to_income"])
    fit, _, _ = sweep.backward_elimination(m, [linalg.CONST] + xs, "employment_to_income", p_max=P_MAX)
    return linalg.ols_coef_table(spark, fit)


# --------------------------------------------------------------------------- E: evaluation on fixed predictions

def _pred(spark, sf):
    return fixture(spark, sf, "fx_pred")


_COUNTS = (
    with_fx("fx_pred")
    + """,
c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn
      FROM fx_pred),
m AS (SELECT CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
             coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS specificity FROM c),
mf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""
)


@query(
    "confusion_matrix",
    with_fx("fx_pred")
    + "\nSELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1 FROM fx_pred GROUP BY label",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_pred(spark, sf))


@query("accuracy", _COUNTS + "\nSELECT round_even(accuracy, 6) AS accuracy FROM mf")
def accuracy_q(spark, sf):
    return evaluate.accuracy(_pred(spark, sf))


@query(
    "precision_recall_f1",
    _COUNTS + "\nSELECT round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM mf",
)
def precision_recall_f1(spark, sf):
    return evaluate.binary_metrics(_pred(spark, sf)).select("precision", "recall", "f1")


@query("specificity", _COUNTS + "\nSELECT round_even(specificity, 6) AS specificity FROM mf")
def specificity(spark, sf):
    return evaluate.binary_metrics(_pred(spark, sf)).select("specificity")


_ROC = (
    with_fx("fx_pred")
    + """,
g AS (SELECT score AS threshold, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
             CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg FROM fx_pred GROUP BY score),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g),
c AS (SELECT threshold, pos, neg,
             sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g)"""
)


@query(
    "roc_curve",
    _ROC
    + """
SELECT threshold, round_even(fp / N, 6) AS fpr, round_even(tp / P, 6) AS tpr FROM c, t
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
)
def roc_curve(spark, sf):
    return evaluate.roc_curve(_pred(spark, sf))


@query(
    "auc",
    _ROC
    + """
SELECT round_even(sum(neg * (tp - pos + pos / 2)) / (max(P) * max(N)), 6) AS auc FROM c, t""",
)
def auc(spark, sf):
    return evaluate.auc(_pred(spark, sf)).select(round_even("auc", 6).alias("auc"))


_LB_MODELS = {
    "fixed": "prediction",
    "score_ge_0_5": "CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END",
    "score_ge_0_3": "CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END",
}


def _lb_sql() -> str:
    parts = []
    for name, expr in _LB_MODELS.items():
        parts.append(
            f"""SELECT '{name}' AS model,
  round_even(avg(CASE WHEN label = p THEN 1.0 ELSE 0.0 END), 3) AS accuracy,
  round_even(coalesce(CAST(count(*) FILTER (WHERE label = 1 AND p = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE p = 1), 0), 0), 3) AS precision,
  round_even(coalesce(CAST(count(*) FILTER (WHERE label = 1 AND p = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0), 0), 3) AS recall,
  round_even(coalesce(2.0 * count(*) FILTER (WHERE label = 1 AND p = 1) / nullif(count(*) FILTER (WHERE p = 1) + count(*) FILTER (WHERE label = 1), 0), 0), 3) AS f1,
  round_even(coalesce(CAST(count(*) FILTER (WHERE label <> 1 AND p <> 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE label <> 1), 0), 0), 3) AS specificity
FROM (SELECT label, {expr} AS p FROM fx_pred)"""
        )
    return with_fx("fx_pred") + "\n" + "\nUNION ALL\n".join(parts)


@query("leaderboard", _lb_sql())
def leaderboard(spark, sf):
    p = _pred(spark, sf)
    preds = {
        name: p.select("label", (F.expr(expr) if name != "fixed" else F.col("prediction")).cast("double").alias("prediction"))
        for name, expr in _LB_MODELS.items()
    }
    return evaluate.leaderboard(preds)


@query(
    "adaboost_reweight",
    with_fx("fx_pred")
    + """,
w AS (SELECT id, label, prediction, 1.0 / count(*) OVER () AS w0, CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END AS miss FROM fx_pred),
e AS (SELECT sum(w0 * miss) / sum(w0) AS err FROM w),
a AS (SELECT ln((1 - err) / err) AS alpha FROM e),
u AS (SELECT id, w0 * exp(alpha * miss) AS w1 FROM w, a)
SELECT id, round_even(w1 / sum(w1) OVER (), 9) AS weight FROM u""",
)
def adaboost_reweight(spark, sf):
    from scorewise.operators.ensemble import samme_reweight

    p = _pred(spark, sf).withColumn("weight", F.lit(1.0))
    out, _ = samme_reweight(p, "label", "prediction", "weight")
    return out.select("id", round_even("weight", 9).alias("weight"))


# --------------------------------------------------------------------------- M: association rules

BASKET_COLS = [
    "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "STATUS",
]
RULE_SUPPORT = 0.05
RULE_CONFIDENCE = 0.7


def _baskets(spark, sf):
    return encode.baskets(prepared(spark, sf), BASKET_COLS)


def _baskets_sql() -> str:
    items = ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND {c} <> (SELECT min({c}) FROM prepared) THEN '{c}_' || {c} END" for c in BASKET_COLS
    )
    return PREP_CTE + f",\nb AS (SELECT ID AS id, list_filter([{items}], lambda x: x IS NOT NULL) AS items FROM prepared)"


@query("baskets", _baskets_sql() + "\nSELECT id, array_to_string(items, '|') AS items, len(items) AS n_items FROM b")
def baskets(spark, sf):
    b = _baskets(spark, sf)
    return b.select("id", F.array_join("items", "|").alias("items"), F.size("items").alias("n_items"))


def _itemsets_sql(max_k: int = len(BASKET_COLS)) -> str:
    base = _baskets_sql() + ",\nx AS (SELECT id, unnest(items) AS it FROM b),\nn AS (SELECT count(*) AS n FROM b)"
    parts = []
    for k in range(1, max_k + 1):
        sel = " || '|' || ".join(f"x{i}.it" for i in range(k))
        joins = " ".join(
            f"JOIN x x{i} ON x{i}.id = x0.id AND x{i}.it > x{i - 1}.it" for i in range(1, k)
        )
        parts.append(
            f"SELECT {sel} AS itemset, {k} AS size, count(*) AS freq FROM x x0 {joins} GROUP BY 1"
        )
    return base + ",\nfi AS (" + "\nUNION ALL\n".join(parts) + f"),\nf AS (SELECT itemset, size, freq, CAST(freq AS DOUBLE) / n AS support FROM fi, n WHERE CAST(freq AS DOUBLE) / n >= {RULE_SUPPORT})"


@query(
    "frequent_itemsets",
    _itemsets_sql() + "\nSELECT itemset, CAST(size AS INTEGER) AS size, freq, round_even(support, 6) AS support FROM f",
)
def frequent_itemsets(spark, sf):
    fi = mine.frequent_itemsets(_baskets(spark, sf), RULE_SUPPORT)
    return fi.select(
        F.array_join("items", "|").alias("itemset"), F.size("items").alias("size"), "freq",
        round_even("support", 6).alias("support"),
    )


def _rules_sql() -> str:
    return (
        _itemsets_sql()
        + f""",
fl AS (SELECT string_split(itemset, '|') AS items, size, support FROM f WHERE size >= 2),
masks AS (SELECT items, size, support, m FROM fl, range(1, CAST(pow(2, size) AS BIGINT) - 1) r(m)),
cand AS (SELECT array_to_string(list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 1), '|') AS antecedents,
                array_to_string(list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 0), '|') AS consequents,
                support FROM masks),
r AS (SELECT cand.antecedents, cand.consequents, fa.support AS antecedent_support, fc.support AS consequent_support,
             cand.support, cand.support / fa.support AS confidence
      FROM cand JOIN f fa ON fa.itemset = cand.antecedents JOIN f fc ON fc.itemset = cand.consequents)"""
    )


_RULE_COLS = """antecedents, consequents, round_even(antecedent_support, 6) AS antecedent_support,
 round_even(consequent_support, 6) AS consequent_support, round_even(support, 6) AS support,
 round_even(confidence, 6) AS confidence, round_even(confidence / consequent_support, 6) AS lift,
 round_even(support - antecedent_support * consequent_support, 6) AS leverage,
 CASE WHEN confidence >= 1 THEN CAST('inf' AS DOUBLE) ELSE round_even((1 - consequent_support) / (1 - confidence), 6) END AS conviction"""


def _rules(spark, sf):
    fi = mine.frequent_itemsets(_baskets(spark, sf), RULE_SUPPORT)
    rules = mine.association_rules(fi, RULE_CONFIDENCE)
    return rules.select(
        F.array_join("antecedents", "|").alias("antecedents"),
        F.array_join("consequents", "|").alias("consequents"),
        *[round_even(c, 6).alias(c) for c in ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage"]],
        F.when(F.col("conviction") == float("inf"), F.col("conviction")).otherwise(round_even("conviction", 6)).alias("conviction"),
    )


@query("association_rules", _rules_sql() + f"\nSELECT {_RULE_COLS} FROM r WHERE confidence >= {RULE_CONFIDENCE}")
def association_rules(spark, sf):
    return _rules(spark, sf)


@query(
    "rules_sorted",
    _rules_sql() + f"\nSELECT {_RULE_COLS} FROM r WHERE confidence >= {RULE_CONFIDENCE} ORDER BY confidence DESC, lift DESC",
)
def rules_sorted(spark, sf):
    return mine.sort_rules(_rules(spark, sf))


# --------------------------------------------------------------------------- parity variants

_ROC_HARD = _ROC.replace("SELECT score AS threshold", "SELECT prediction AS threshold").replace("GROUP BY score)", "GROUP BY prediction)")


@query(
    "roc_curve_hard",
    _ROC_HARD
    + """
SELECT threshold, round_even(fp / N, 6) AS fpr, round_even(tp / P, 6) AS tpr FROM c, t
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
)
def roc_curve_hard(spark, sf):
    """ROC points from hard 0/1 predictions (three points), as the reference draws them."""
    return evaluate.roc_curve(_pred(spark, sf), score="prediction")


@query(
    "auc_hard",
    _ROC_HARD + "\nSELECT round_even(sum(neg * (tp - pos + pos / 2)) / (max(P) * max(N)), 6) AS auc FROM c, t",
)
def auc_hard(spark, sf):
    """AUC of hard predictions; equals (TPR + TNR) / 2."""
    return evaluate.auc(_pred(spark, sf), score="prediction").select(round_even("auc", 6).alias("auc"))


REFERENCE_SUPPORT = 0.2


@query(
    "frequent_itemsets_reference_support",
    _itemsets_sql().replace(f">= {RULE_SUPPORT})", f">= {REFERENCE_SUPPORT})")
    + "\nSELECT itemset, CAST(size AS INTEGER) AS size, freq, round_even(support, 6) AS support FROM f",
)
def frequent_itemsets_reference_support(spark, sf):
    """Frequent itemsets at the reference's own minimum support (0.2)."""
    fi = mine.frequent_itemsets(_baskets(spark, sf), REFERENCE_SUPPORT)
    return fi.select(
        F.array_join("items", "|").alias("itemset"), F.size("items").alias("size"), "freq",
        round_even("support", 6).alias("support"),
    )
