"""Registered relational queries (scans, projections, joins, aggregates, windows).

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame; each oracle
is the DuckDB twin over the same fixture views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.functions.scalar import (
    clamp_double,
    clamp_int,
    round_even,
    safe_ratio,
    split_bucket,
    split_bucket_sql,
)
from scorewise.operators import clean, ordinal, profile
from scorewise.operators.encode import indicators
from scorewise.plans.duck import JOINED_CTES, PREP_CTE, with_fx
from scorewise.plans.registry import query
from scorewise.sources.fixtures import APP_COLUMNS, fixture
from scorewise.sources.tables import APPLICATION_SCHEMA, CREDIT_SCHEMA, conform

SPLIT_SEED = 5805


def app(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_application")


def credit(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_credit")


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return clean.joined_applicants(app(spark, sf), credit(spark, sf))


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return clean.add_response(joined(spark, sf))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return clean.prepared(app(spark, sf), credit(spark, sf))


def fx_reg(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_reg")


# --------------------------------------------------------------------------- flagship

@query(
    "good_rate_by_income_type",
    PREP_CTE
    + """
SELECT NAME_INCOME_TYPE, count(*) AS n, CAST(sum(response) AS DOUBLE) AS n_good,
       round_even(avg(response), 6) AS good_rate
FROM prepared GROUP BY NAME_INCOME_TYPE""",
)
def good_rate_by_income_type(spark, sf):
    return prepared(spark, sf).groupBy("NAME_INCOME_TYPE").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("response").alias("n_good"),
        round_even(F.avg("response"), 6).alias("good_rate"),
    )


# --------------------------------------------------------------------------- S: scans

@query("scan_csv_application", with_fx("fx_application") + "\nSELECT * FROM fx_application")
def scan_csv_application(spark, sf):
    return conform(app(spark, sf), APPLICATION_SCHEMA)


@query("scan_csv_credit", with_fx("fx_credit") + "\nSELECT * FROM fx_credit")
def scan_csv_credit(spark, sf):
    return conform(credit(spark, sf), CREDIT_SCHEMA)


@query(
    "row_ordinal",
    with_fx("fx_application")
    + "\nSELECT ID, ROW_NO, row_number() OVER (ORDER BY ROW_NO) - 1 AS row_idx FROM fx_application",
)
def row_ordinal(spark, sf):
    return ordinal.with_row_index(app(spark, sf).select("ID", "ROW_NO"), "ROW_NO", "row_idx")


_APP_TYPES = [("ROW_NO", "bigint"), *((f.name, f.dataType.simpleString()) for f in APPLICATION_SCHEMA)]


def _union_per_column(select_for) -> str:
    return "\nUNION ALL\n".join(select_for(i, c, t) for i, (c, t) in enumerate(_APP_TYPES))


@query(
    "profile_info",
    with_fx("fx_application")
    + "\n"
    + _union_per_column(
        lambda i, c, t: f"SELECT {i} AS ordinal, '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM fx_application"
    ),
)
def profile_info(spark, sf):
    return profile.profile_info(app(spark, sf))


@query("head_n", with_fx("fx_application") + "\nSELECT * FROM fx_application ORDER BY ROW_NO LIMIT 10")
def head_n(spark, sf):
    return app(spark, sf).orderBy("ROW_NO").limit(10)


@query("table_shape", PREP_CTE + "\nSELECT count(*) AS n_rows, CAST(22 AS BIGINT) AS n_cols FROM prepared")
def table_shape(spark, sf):
    return profile.table_shape(prepared(spark, sf))


# --------------------------------------------------------------------------- P: projections / filters

# The features of all models; <column>_<category> is that category's indicator.
FEATURES = [
    "OCCUPATION_TYPE_High skill tech staff", "OCCUPATION_TYPE_Medicine staff", "OCCUPATION_TYPE_Security staff",
    "NAME_HOUSING_TYPE_With parents", "FLAG_EMAIL", "NAME_HOUSING_TYPE_House / apartment",
    "NAME_FAMILY_STATUS_Separated", "NAME_EDUCATION_TYPE_Incomplete higher", "NAME_INCOME_TYPE_State servant",
    "OCCUPATION_TYPE_Drivers", "CODE_GENDER_M", "OCCUPATION_TYPE_Managers",
    "NAME_FAMILY_STATUS_Single / not married", "NAME_FAMILY_STATUS_Married", "NAME_INCOME_TYPE_Working",
    "FLAG_OWN_CAR_Y", "DAYS_EMPLOYED", "OCCUPATION_TYPE_Core staff", "FLAG_OWN_REALTY_Y", "CNT_FAM_MEMBERS",
    "FLAG_WORK_PHONE", "FLAG_PHONE", "OCCUPATION_TYPE_Sales staff",
    "NAME_EDUCATION_TYPE_Secondary / secondary special", "NAME_EDUCATION_TYPE_Higher education",
    "OCCUPATION_TYPE_Laborers", "AMT_INCOME_TOTAL",
]


def _feature_sql(name: str) -> str:
    if name in APP_COLUMNS:
        return name
    col = next(c for c in APP_COLUMNS if name.startswith(c + "_"))
    return f"CAST(CASE WHEN {col} = '{name[len(col) + 1:]}' THEN 1 ELSE 0 END AS INTEGER) AS \"{name}\""


FEATURES_SQL = ", ".join(_feature_sql(name) for name in FEATURES)


@query(
    "project_features",
    PREP_CTE + f"\nSELECT ID, {FEATURES_SQL}, response FROM prepared",
)
def project_features(spark, sf):
    p = prepared(spark, sf)
    return p.select("ID", *indicators(p, FEATURES), "response")


@query(
    "drop_columns",
    PREP_CTE
    + """
SELECT ROW_NO, CODE_GENDER, FLAG_OWN_CAR, FLAG_OWN_REALTY, AMT_INCOME_TOTAL, NAME_INCOME_TYPE,
       NAME_EDUCATION_TYPE, NAME_FAMILY_STATUS, NAME_HOUSING_TYPE, DAYS_EMPLOYED, FLAG_WORK_PHONE, FLAG_PHONE,
       FLAG_EMAIL, OCCUPATION_TYPE, CNT_FAM_MEMBERS, MONTHS_BALANCE, response
FROM prepared""",
)
def drop_columns(spark, sf):
    return prepared(spark, sf).drop("ID", "STATUS", "CNT_CHILDREN", "FLAG_MOBIL", "DAYS_BIRTH")


@query(
    "select_non_numeric",
    PREP_CTE
    + """
SELECT CODE_GENDER, FLAG_OWN_CAR, FLAG_OWN_REALTY, NAME_INCOME_TYPE, NAME_EDUCATION_TYPE, NAME_FAMILY_STATUS,
       NAME_HOUSING_TYPE, OCCUPATION_TYPE, STATUS
FROM prepared""",
)
def select_non_numeric(spark, sf):
    return profile.select_non_numeric(prepared(spark, sf))


@query("filter_range", with_fx("fx_application") + "\nSELECT * FROM fx_application WHERE CNT_CHILDREN >= 0")
def filter_range(spark, sf):
    return app(spark, sf).filter(F.col("CNT_CHILDREN") >= 0)


@query(
    "label_response",
    with_fx("fx_credit")
    + """
SELECT *, CASE WHEN STATUS IN ('X','C','0') THEN CAST(1.0 AS DOUBLE)
               WHEN STATUS IN ('1','2','3','4','5') THEN CAST(0.0 AS DOUBLE) END AS response
FROM fx_credit""",
)
def label_response(spark, sf):
    return clean.add_response(credit(spark, sf))


@query(
    "clamp_int",
    with_fx("fx_application")
    + """
SELECT ID, ROW_NO, CASE WHEN CNT_FAM_MEMBERS IS NULL THEN NULL
       ELSE greatest(CAST(trunc(CNT_FAM_MEMBERS) AS INTEGER), 0) END AS CNT_FAM_MEMBERS
FROM fx_application""",
)
def clamp_int_q(spark, sf):
    return app(spark, sf).select("ID", "ROW_NO", clamp_int("CNT_FAM_MEMBERS").alias("CNT_FAM_MEMBERS"))


@query(
    "clamp_double",
    with_fx("fx_application")
    + """
SELECT ID, ROW_NO, CASE WHEN AMT_INCOME_TOTAL IS NULL THEN NULL
       ELSE greatest(CAST(AMT_INCOME_TOTAL AS DOUBLE), 0.0) END AS AMT_INCOME_TOTAL
FROM fx_application""",
)
def clamp_double_q(spark, sf):
    return app(spark, sf).select("ID", "ROW_NO", clamp_double("AMT_INCOME_TOTAL").alias("AMT_INCOME_TOTAL"))


@query(
    "ratio_safe",
    with_fx("fx_application")
    + """
SELECT ID, ROW_NO, round_even(DAYS_EMPLOYED / nullif(greatest(AMT_INCOME_TOTAL, 0.0), 0.0), 6) AS employment_to_income
FROM fx_application
WHERE DAYS_EMPLOYED / nullif(greatest(AMT_INCOME_TOTAL, 0.0), 0.0) IS NOT NULL""",
)
def ratio_safe(spark, sf):
    df = app(spark, sf).select(
        "ID", "ROW_NO", safe_ratio("DAYS_EMPLOYED", clamp_double("AMT_INCOME_TOTAL")).alias("employment_to_income")
    )
    return df.filter(F.col("employment_to_income").isNotNull()).withColumn(
        "employment_to_income", round_even("employment_to_income", 6)
    )


@query(
    "add_constant",
    with_fx("fx_reg") + "\nSELECT id, x1, x2, x3, CAST(1.0 AS DOUBLE) AS const FROM fx_reg",
)
def add_constant(spark, sf):
    from scorewise.operators.linalg import add_constant as add_const

    return add_const(fx_reg(spark, sf).select("id", "x1", "x2", "x3"), ["x1", "x2", "x3"])


@query(
    "sample_every_k",
    with_fx("fx_application")
    + "\nSELECT * FROM fx_application QUALIFY (row_number() OVER (ORDER BY ROW_NO) - 1) % 4 = 0",
)
def sample_every_k(spark, sf):
    return ordinal.sample_every_k(app(spark, sf), 4, "ROW_NO")


@query(
    "impute_mode",
    with_fx("fx_application")
    + """,
m AS (SELECT OCCUPATION_TYPE AS v FROM fx_application WHERE OCCUPATION_TYPE IS NOT NULL
      GROUP BY OCCUPATION_TYPE ORDER BY count(*) DESC, OCCUPATION_TYPE LIMIT 1)
SELECT ROW_NO, ID, coalesce(OCCUPATION_TYPE, (SELECT v FROM m)) AS OCCUPATION_TYPE FROM fx_application""",
)
def impute_mode(spark, sf):
    return clean.impute_mode(app(spark, sf).select("ROW_NO", "ID", "OCCUPATION_TYPE"), "OCCUPATION_TYPE")


@query(
    "mode_occupation",
    "WITH "
    + JOINED_CTES.strip()
    + """
SELECT OCCUPATION_TYPE AS mode_value, count(*) AS mode_count FROM app_semi WHERE OCCUPATION_TYPE IS NOT NULL
GROUP BY OCCUPATION_TYPE ORDER BY count(*) DESC, OCCUPATION_TYPE LIMIT 1""",
)
def mode_occupation(spark, sf):
    return clean.mode_value(clean.semi_join(app(spark, sf), credit(spark, sf)), "OCCUPATION_TYPE")


@query(
    "round_half_even",
    with_fx("fx_application")
    + """
SELECT ID, ROW_NO, round_even(AMT_INCOME_TOTAL / 8, 2) AS income_2dp, round_even(CNT_FAM_MEMBERS / 8, 2) AS fam_2dp
FROM fx_application""",
)
def round_half_even(spark, sf):
    return app(spark, sf).select(
        "ID",
        "ROW_NO",
        round_even(F.col("AMT_INCOME_TOTAL") / 8, 2).alias("income_2dp"),
        round_even(F.col("CNT_FAM_MEMBERS") / 8, 2).alias("fam_2dp"),
    )


@query(
    "concat_columns",
    PREP_CTE + f"\nSELECT ID, {FEATURES_SQL}, response FROM prepared",
)
def concat_columns(spark, sf):
    p = prepared(spark, sf)
    x = p.select("ID", *indicators(p, FEATURES))
    y = p.select("ID", "response")
    return x.join(y, on="ID", how="inner")


@query(
    "rescale_affine",
    with_fx("fx_reg")
    + """,
s AS (SELECT avg(y) AS m, stddev_samp(y) AS sd FROM fx_reg)
SELECT id, round_even(x1 * sd + m, 6) AS x1_rescaled FROM fx_reg, s""",
)
def rescale_affine(spark, sf):
    from scorewise.operators.encode import rescale_affine as rescale

    reg = fx_reg(spark, sf)
    return rescale(reg.select("id", "x1"), "x1", reg, "y", "x1_rescaled")


# --------------------------------------------------------------------------- J: joins

@query("semi_join_app", "WITH " + JOINED_CTES.strip() + "\nSELECT * FROM app_semi")
def semi_join_app(spark, sf):
    return clean.semi_join(app(spark, sf), credit(spark, sf))


@query("semi_join_credit", "WITH " + JOINED_CTES.strip() + "\nSELECT * FROM cr_semi")
def semi_join_credit(spark, sf):
    a = clean.semi_join(app(spark, sf), credit(spark, sf))
    return clean.semi_join(credit(spark, sf), a)


@query("inner_join_app_credit", "WITH " + JOINED_CTES.strip() + "\nSELECT * FROM joined")
def inner_join_app_credit(spark, sf):
    return joined(spark, sf)


@query(
    "overlap_count",
    with_fx("fx_application", "fx_credit")
    + "\nSELECT count(DISTINCT ID) AS n_shared_ids FROM fx_application WHERE ID IN (SELECT ID FROM fx_credit)",
)
def overlap_count(spark, sf):
    return clean.overlap_count(app(spark, sf), credit(spark, sf))


# --------------------------------------------------------------------------- A: aggregates

@query(
    "nunique_all",
    with_fx("fx_application")
    + "\n"
    + _union_per_column(
        lambda i, c, t: f"SELECT {i} AS ordinal, '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM fx_application"
    ),
)
def nunique_all(spark, sf):
    return profile.nunique(app(spark, sf))


_SEMI_NULLS = "WITH " + JOINED_CTES.strip() + "\n" + _union_per_column(
    lambda i, c, t: f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"round_even(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS null_ratio FROM app_semi"
)


@query("null_count", f"SELECT ordinal, column_name, null_count FROM ({_SEMI_NULLS})")
def null_count(spark, sf):
    return profile.null_counts(clean.semi_join(app(spark, sf), credit(spark, sf))).select(
        "ordinal", "column_name", "null_count"
    )


@query("null_ratio", f"SELECT ordinal, column_name, null_ratio FROM ({_SEMI_NULLS})")
def null_ratio(spark, sf):
    return profile.null_counts(clean.semi_join(app(spark, sf), credit(spark, sf))).select(
        "ordinal", "column_name", "null_ratio"
    )


@query("row_count", PREP_CTE + "\nSELECT count(*) AS n_rows FROM prepared")
def row_count(spark, sf):
    return prepared(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "value_counts",
    PREP_CTE + "\nSELECT response, count(*) AS count FROM prepared WHERE response IS NOT NULL GROUP BY response",
)
def value_counts(spark, sf):
    return profile.value_counts(prepared(spark, sf), "response")


@query(
    "count_by_1d",
    PREP_CTE + "\nSELECT NAME_EDUCATION_TYPE, count(*) AS count FROM prepared GROUP BY NAME_EDUCATION_TYPE",
)
def count_by_1d(spark, sf):
    return profile.count_by(prepared(spark, sf), "NAME_EDUCATION_TYPE")


@query(
    "count_by_2d",
    PREP_CTE
    + "\nSELECT NAME_EDUCATION_TYPE, CODE_GENDER, count(*) AS count FROM prepared GROUP BY NAME_EDUCATION_TYPE, CODE_GENDER",
)
def count_by_2d(spark, sf):
    return profile.count_by(prepared(spark, sf), "NAME_EDUCATION_TYPE", "CODE_GENDER")


def _box_sql(source: str, group: str, value: str) -> str:
    return f"""
q AS (SELECT {group}, count(*) AS n,
             quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
             quantile_cont({value}, 0.75) AS q3
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lof, q3 + 1.5 * (q3 - q1) AS hif FROM q)
SELECT f.{group}, f.n, round_even(f.q1, 6) AS q1, round_even(f.median, 6) AS median, round_even(f.q3, 6) AS q3,
       round_even(min(CASE WHEN v >= lof AND v <= hif THEN v END), 6) AS whisker_low,
       round_even(max(CASE WHEN v >= lof AND v <= hif THEN v END), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= lof AND v <= hif)) AS n_outliers
FROM f JOIN (SELECT {group}, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL) d
  ON d.{group} = f.{group}
GROUP BY f.{group}, f.n, f.q1, f.median, f.q3"""


@query(
    "box_stats_grouped",
    "WITH " + JOINED_CTES.strip() + "," + _box_sql("joined", "CODE_GENDER", "AMT_INCOME_TOTAL"),
)
def box_stats_grouped(spark, sf):
    return profile.box_stats(joined(spark, sf), "AMT_INCOME_TOTAL", ["CODE_GENDER"])


_BOX_COLS = ["AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "MONTHS_BALANCE", "FLAG_WORK_PHONE"]


@query(
    "box_stats_columns",
    PREP_CTE
    + ",\nlong AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM prepared" for c in _BOX_COLS
    )
    + "),"
    + _box_sql("long", "column_name", "value"),
)
def box_stats_columns(spark, sf):
    return profile.box_stats_columns(prepared(spark, sf), _BOX_COLS)


_STD_COLS = ["AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "MONTHS_BALANCE"]


@query(
    "mean_std",
    PREP_CTE
    + "\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std FROM prepared"
        for c in _STD_COLS
    ),
)
def mean_std(spark, sf):
    return profile.mean_std(prepared(spark, sf), _STD_COLS)


_CORR_COLS = ["ID", "CNT_CHILDREN", "AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "FLAG_WORK_PHONE",
              "CNT_FAM_MEMBERS", "MONTHS_BALANCE", "response"]


def _pair_sql(fn: str, alias: str, source: str) -> str:
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even({fn}({a}, {b}), 1) AS {alias} FROM {source}"
            )
    return "\nUNION ALL\n".join(parts)


@query("corr_matrix", "WITH " + JOINED_CTES.strip() + "\n" + _pair_sql("corr", "corr", "labeled"))
def corr_matrix(spark, sf):
    return profile.pairwise(labeled(spark, sf), _CORR_COLS, "corr", 1)


@query("cov_matrix", "WITH " + JOINED_CTES.strip() + "\n" + _pair_sql("covar_samp", "cov", "labeled"))
def cov_matrix(spark, sf):
    return profile.pairwise(labeled(spark, sf), _CORR_COLS, "cov", 1)


@query(
    "dup_rows_count",
    with_fx("fx_application", "fx_credit")
    + """
SELECT (SELECT count(*) FROM fx_application) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (ROW_NO) FROM fx_application)) AS app_dup_rows,
       (SELECT count(*) FROM fx_credit) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (ROW_NO) FROM fx_credit)) AS credit_dup_rows""",
)
def dup_rows_count(spark, sf):
    a = clean.dup_rows_count(app(spark, sf)).withColumnRenamed("dup_rows", "app_dup_rows")
    c = clean.dup_rows_count(credit(spark, sf)).withColumnRenamed("dup_rows", "credit_dup_rows")
    return a.crossJoin(c)


@query(
    "dup_key_rows",
    with_fx("fx_application")
    + "\nSELECT * FROM fx_application QUALIFY row_number() OVER (PARTITION BY ID ORDER BY ROW_NO) > 1",
)
def dup_key_rows(spark, sf):
    return clean.dup_key_rows(app(spark, sf))


@query(
    "dedup_reject",
    with_fx("fx_application")
    + "\nSELECT * FROM fx_application QUALIFY count(*) OVER (PARTITION BY ID) = 1",
)
def dedup_reject(spark, sf):
    return clean.dedup_reject(app(spark, sf))


@query(
    "dedup_keep_first",
    with_fx("fx_application")
    + "\nSELECT * FROM fx_application QUALIFY row_number() OVER (PARTITION BY ID ORDER BY ROW_NO) = 1",
)
def dedup_keep_first(spark, sf):
    return clean.dedup_keep_first(app(spark, sf))


_GRAM_COLS = ["x1", "x2", "x3", "y"]


def _gram_sql() -> str:
    parts = []
    for a in _GRAM_COLS:
        for b in _GRAM_COLS:
            parts.append(f"SELECT '{a}' AS row_name, '{b}' AS col_name, round_even(sum({a} * {b}), 2) AS value FROM fx_reg")
    for a in _GRAM_COLS:
        parts.append(f"SELECT '{a}' AS row_name, '1' AS col_name, round_even(sum({a}), 2) AS value FROM fx_reg")
    parts.append("SELECT '1' AS row_name, '1' AS col_name, CAST(count(*) AS DOUBLE) AS value FROM fx_reg")
    return with_fx("fx_reg") + "\n" + "\nUNION ALL\n".join(parts)


@query("gram_matrix", _gram_sql())
def gram_matrix(spark, sf):
    g = profile.gram_long(fx_reg(spark, sf), _GRAM_COLS)
    return g.withColumn("value", round_even("value", 2))


# --------------------------------------------------------------------------- O / U / F11

@query(
    "argmax_by",
    with_fx("fx_reg")
    + """
SELECT CAST(x3 AS BIGINT) AS grp, id AS argmax_id, round_even(y, 6) AS max_y FROM fx_reg
QUALIFY row_number() OVER (PARTITION BY x3 ORDER BY y DESC, id) = 1""",
)
def argmax_by(spark, sf):
    reg = fx_reg(spark, sf)
    best = reg.groupBy("x3").agg(F.max_by(F.struct("id", "y"), F.struct(F.col("y"), -F.col("id"))).alias("b"))
    return best.select(
        F.col("x3").cast("long").alias("grp"), F.col("b.id").alias("argmax_id"), round_even("b.y", 6).alias("max_y")
    )


@query(
    "split_counts",
    with_fx("fx_reg")
    + f"""
SELECT CASE WHEN {split_bucket_sql('id', SPLIT_SEED)} < 20 THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM fx_reg GROUP BY 1""",
)
def split_counts(spark, sf):
    reg = fx_reg(spark, sf)
    return reg.groupBy(
        F.when(split_bucket("id", SPLIT_SEED) < 20, "test").otherwise("train").alias("split")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "iqr_filter",
    PREP_CTE
    + """,
q AS (SELECT quantile_cont(AMT_INCOME_TOTAL, 0.25) AS q1, quantile_cont(AMT_INCOME_TOTAL, 0.75) AS q3 FROM prepared),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lof, q3 + 1.5 * (q3 - q1) AS hif FROM q),
k AS (SELECT count(*) AS n FROM prepared, f WHERE AMT_INCOME_TOTAL > lof AND AMT_INCOME_TOTAL < hif)
SELECT prepared.* FROM prepared, f, k
WHERE (AMT_INCOME_TOTAL > lof AND AMT_INCOME_TOTAL < hif) OR k.n = 0""",
)
def iqr_filter(spark, sf):
    return profile.iqr_filter(prepared(spark, sf), "AMT_INCOME_TOTAL")
