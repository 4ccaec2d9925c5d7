"""Shared DuckDB CTE text for the oracle queries.

``PREP_CTE`` mirrors ``operators.clean.prepared``: semi-joins both ways, mode of
occupation after the first semi-join, keep-first per ID on both sides, inner
join, label, ``CNT_CHILDREN >= 0`` and clamps.
"""

from __future__ import annotations

from scorewise.sources.fixtures import APP_COLUMNS, FIXTURE_SQL, FX_POINTS_DUCK_SQL

def _columns(**changed: str) -> str:
    """The applicant columns, some of them as an expression."""
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in APP_COLUMNS)


_FILLED = _columns(OCCUPATION_TYPE="coalesce(OCCUPATION_TYPE, (SELECT m FROM occ_mode))")
_CLAMPED = _columns(
    AMT_INCOME_TOTAL="CASE WHEN AMT_INCOME_TOTAL IS NULL THEN NULL ELSE greatest(CAST(AMT_INCOME_TOTAL AS DOUBLE), 0.0) END",
    CNT_FAM_MEMBERS="CASE WHEN CNT_FAM_MEMBERS IS NULL THEN NULL ELSE greatest(CAST(trunc(CNT_FAM_MEMBERS) AS INTEGER), 0) END",
)


def fx(name: str) -> str:
    sql = FX_POINTS_DUCK_SQL if name == "fx_points" else FIXTURE_SQL[name]
    return f"{name} AS ({sql.strip()})"


JOINED_CTES = f"""
{fx('fx_application')},
{fx('fx_credit')},
app_semi AS (SELECT * FROM fx_application WHERE ID IN (SELECT ID FROM fx_credit)),
cr_semi AS (SELECT * FROM fx_credit WHERE ID IN (SELECT ID FROM app_semi)),
occ_mode AS (SELECT OCCUPATION_TYPE AS m FROM app_semi WHERE OCCUPATION_TYPE IS NOT NULL
             GROUP BY OCCUPATION_TYPE ORDER BY count(*) DESC, OCCUPATION_TYPE LIMIT 1),
app_filled AS (SELECT {_FILLED} FROM app_semi),
app_first AS (SELECT * FROM app_filled QUALIFY row_number() OVER (PARTITION BY ID ORDER BY ROW_NO) = 1),
cr_first AS (SELECT * FROM cr_semi QUALIFY row_number() OVER (PARTITION BY ID ORDER BY ROW_NO) = 1),
joined AS (SELECT a.*, c.MONTHS_BALANCE, c.STATUS FROM app_first a JOIN cr_first c ON a.ID = c.ID),
labeled AS (SELECT *, CASE WHEN STATUS IN ('X','C','0') THEN CAST(1.0 AS DOUBLE)
                           WHEN STATUS IN ('1','2','3','4','5') THEN CAST(0.0 AS DOUBLE) END AS response
            FROM joined)"""

PREP_CTE = (
    "WITH "
    + JOINED_CTES.strip()
    + f""",
prepared AS (SELECT {_CLAMPED}, MONTHS_BALANCE, STATUS, response FROM labeled WHERE CNT_CHILDREN >= 0)"""
)


def with_fx(*names: str) -> str:
    return "WITH " + ",\n".join(fx(n) for n in names)
