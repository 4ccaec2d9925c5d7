"""Fixture views over the driver tables.

The same SQL text builds the views in Spark and in DuckDB, so every oracle query
can inline them as CTEs.  The role each view plays (applicant table, monthly
credit-status table, predictions, points, regression table) is described in
FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewise.sources.tables import APPLICATION_SCHEMA

# The categories of the applicant table's string columns, in sorted order.
INCOME_TYPES = ["Commercial associate", "Pensioner", "State servant", "Student", "Working"]
EDUCATION_TYPES = [
    "Academic degree", "Higher education", "Incomplete higher", "Lower secondary", "Secondary / secondary special",
]
FAMILY_STATUSES = ["Civil marriage", "Married", "Separated", "Single / not married", "Widow"]
HOUSING_TYPES = [
    "Co-op apartment", "House / apartment", "Municipal apartment", "Office apartment", "Rented apartment", "With parents",
]
OCCUPATIONS = [
    "Accountants", "Cleaning staff", "Cooking staff", "Core staff", "Drivers", "HR staff", "High skill tech staff",
    "IT staff", "Laborers", "Low-skill Laborers", "Managers", "Medicine staff", "Private service staff",
    "Realty agents", "Sales staff", "Secretaries", "Security staff", "Waiters/barmen staff",
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _pick(key: str, keys: list, values: list[str]) -> str:
    whens = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in zip(keys, values))
    return f"CASE {key} {whens} END"


def _nth(number: str, values: list[str]) -> str:
    return _pick(f"{number} % {len(values)}", list(range(len(values))), values)


#: The applicant table's columns, as the source has them, after the fixture's own row number.
APP_COLUMNS = ["ROW_NO", *APPLICATION_SCHEMA.fieldNames()]

FX_APPLICATION_SQL = f"""
WITH base AS (
 SELECT c_custkey AS ROW_NO,
  CASE WHEN c_custkey % 10 = 9 THEN c_custkey + 1000000000 ELSE c_custkey END AS ID,
  CASE WHEN c_nationkey < 12 THEN 'F' ELSE 'M' END AS CODE_GENDER,
  CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
  CASE WHEN c_custkey % 5 < 3 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  CAST(c_custkey % 6 AS INT) - 1 AS CNT_CHILDREN,
  c_acctbal AS AMT_INCOME_TOTAL,
  {_pick("c_mktsegment", SEGMENTS, INCOME_TYPES)} AS NAME_INCOME_TYPE,
  {_nth("r_regionkey", EDUCATION_TYPES)} AS NAME_EDUCATION_TYPE,
  {_nth("(c_custkey * 13 % 31)", FAMILY_STATUSES)} AS NAME_FAMILY_STATUS,
  {_nth("(c_custkey * 11 % 37)", HOUSING_TYPES)} AS NAME_HOUSING_TYPE,
  CAST(-(7000 + (c_custkey * 53) % 18000) AS INT) AS DAYS_BIRTH,
  CAST(-((c_custkey * 37) % 5000) AS INT) AS DAYS_EMPLOYED,
  1 AS FLAG_MOBIL,
  CAST((c_custkey * 7) % 11 % 2 AS INT) AS FLAG_WORK_PHONE,
  CAST((c_custkey * 5) % 13 % 2 AS INT) AS FLAG_PHONE,
  CASE WHEN (c_custkey * 3) % 29 % 7 = 0 THEN 1 ELSE 0 END AS FLAG_EMAIL,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {_nth("n_nationkey", OCCUPATIONS)} END AS OCCUPATION_TYPE,
  CAST(1 + c_custkey % 4 AS DOUBLE) AS CNT_FAM_MEMBERS
 FROM customer JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM base
UNION ALL
SELECT ROW_NO + 100000000 AS ROW_NO, {", ".join(APP_COLUMNS[1:])}
FROM base WHERE ID % 50 = 0
"""

FX_CREDIT_SQL = """
SELECT o_orderkey AS ROW_NO,
 CASE WHEN o_custkey % 10 = 8 THEN o_custkey + 2000000000 ELSE o_custkey END AS ID,
 CAST((year(o_orderdate) - 2001) * 12 + month(o_orderdate) - 12 AS INT) AS MONTHS_BALANCE,
 CASE o_orderstatus
  WHEN 'F' THEN 'C'
  WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE '0' END
  ELSE CASE WHEN o_orderkey % 3 = 0 THEN substring(o_orderpriority, 1, 1) ELSE '0' END
 END AS STATUS
FROM orders
"""

FX_PRED_SQL = """
SELECT l.doc_id AS id, CAST(l.quality AS DOUBLE) AS label,
 CAST(CASE WHEN n_chars % 7 < 5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
 CAST(n_chars % 97 AS DOUBLE) / 97 AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

FX_REG_SQL = """
SELECT o_orderkey AS id,
 CAST(o_orderkey % 101 AS DOUBLE) AS x1, CAST(o_custkey % 37 AS DOUBLE) AS x2, CAST(o_orderkey % 13 AS DOUBLE) AS x3,
 3.0 * (o_orderkey % 101) - 2.0 * (o_custkey % 37) + o_totalprice / 10000 AS y
FROM orders
"""

#: Three regressors of which one nearly follows from the other two.
FX_COLLINEAR_SQL = """
SELECT o_orderkey AS id,
 CAST(o_orderkey % 101 AS DOUBLE) AS x1, CAST(o_custkey % 37 AS DOUBLE) AS x2,
 3.0 * (o_orderkey % 101) - 2.0 * (o_custkey % 37) + (o_orderkey % 13) / 4.0 AS x3
FROM orders
"""

# DuckDB and Spark spell the element cast differently; the rest is shared.
FX_POINTS_SPARK_SQL = """
SELECT vec_id AS id, transform(embedding, x -> CAST(x AS DOUBLE)) AS v, label FROM embeddings
"""
FX_POINTS_DUCK_SQL = """
SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
"""

FIXTURE_SQL = {
    "fx_application": FX_APPLICATION_SQL,
    "fx_credit": FX_CREDIT_SQL,
    "fx_pred": FX_PRED_SQL,
    "fx_reg": FX_REG_SQL,
    "fx_collinear": FX_COLLINEAR_SQL,
}


#: The driver tables that each fixture view reads.
NEEDS = {
    "fx_application": ("customer", "nation", "region"),
    "fx_credit": ("orders",),
    "fx_pred": ("labels", "documents"),
    "fx_reg": ("orders",),
    "fx_collinear": ("orders",),
    "fx_points": ("embeddings",),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view; only the tables that it reads are opened."""
    for table in NEEDS[name]:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(FX_POINTS_SPARK_SQL if name == "fx_points" else FIXTURE_SQL[name])
