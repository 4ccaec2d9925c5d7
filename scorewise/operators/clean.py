"""Key hygiene, de-duplication, imputation and the applicant/credit join.

Everything is keyed on ``ID`` so Catalyst can reuse one hash partitioning of
each side for the keep-first aggregate and the inner join.  Keep-first and
reject de-duplication are aggregates (``min_by`` on the ordinal) rather than
windows or joins, so partial aggregation collapses a hot key map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.functions.scalar import clamp_double, clamp_int, response


def semi_join(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right`` (``isin``)."""
    return left.join(right.select(key), on=key, how="left_semi").select(*left.columns)


def overlap_count(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Number of distinct keys of ``left`` that also occur in ``right``."""
    return semi_join(left.select(key), right, key).agg(
        F.count_distinct(key).alias("n_shared_ids")
    )


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """One-row table with the most frequent non-null value; ties -> smallest value.

    Counting is a distributed group-by; only the per-partition top-1 of the
    small count table reaches the final task.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).select(
        F.col(col).alias("mode_value"), F.col("_n").alias("mode_count")
    )


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    """Fill nulls of ``col`` with its mode, lazily (one-row broadcast, no collect)."""
    mode = F.broadcast(mode_value(df, col).select("mode_value"))
    cols = [
        F.coalesce(F.col(c), F.col("mode_value")).alias(c) if c == col else F.col(c)
        for c in df.columns
    ]
    return df.crossJoin(mode).select(*cols)


def dedup_keep_first(df: DataFrame, key: str = "ID", order_col: str = "ROW_NO") -> DataFrame:
    """``drop_duplicates(key)``: the first row per key in ``order_col`` order.

    One ``min_by`` per column (the ordinal is unique, so all values come from
    the same row).  Separate aggregates let Catalyst prune the columns a caller
    never reads, so they are not carried through the shuffle.
    """
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        *[(F.min(order_col) if c == order_col else F.min_by(F.col(c), F.col(order_col))).alias(c) for c in others]
    )
    return picked.select(*df.columns)


def dedup_reject(df: DataFrame, key: str = "ID", order_col: str = "ROW_NO") -> DataFrame:
    """``drop_duplicates(key, keep=False)``: drop every row of a repeated key.

    One aggregate (count + the row itself): a hot key is reduced map-side to
    one partial row per task and then dropped, never shuffled in full.
    """
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[(F.min(order_col) if c == order_col else F.min_by(F.col(c), F.col(order_col))).alias(c) for c in others],
    )
    return agg.filter(F.col("_n") == 1).select(*df.columns)


def dup_key_rows(df: DataFrame, key: str = "ID", order_col: str = "ROW_NO") -> DataFrame:
    """``df[df.duplicated(key)]``: rows whose key already occurred earlier."""
    first = df.groupBy(key).agg(F.min(order_col).alias("_first"))
    return (
        df.join(first, on=key, how="inner")
        .filter(F.col(order_col) > F.col("_first"))
        .drop("_first")
    )


def dup_rows_count(df: DataFrame, exclude: tuple[str, ...] = ("ROW_NO",)) -> DataFrame:
    """Count of fully duplicated rows (every copy but the first)."""
    cols = [c for c in df.columns if c not in exclude]
    distinct = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("_d"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return total.crossJoin(distinct).select((F.col("_n") - F.col("_d")).alias("dup_rows"))


def add_response(df: DataFrame, status: str = "STATUS", name: str = "response") -> DataFrame:
    return df.withColumn(name, response(status))


def clean_applicant_columns(df: DataFrame) -> DataFrame:
    """``CNT_CHILDREN >= 0``; clamp family size (int) and income (double) at 0."""
    return (
        df.filter(F.col("CNT_CHILDREN") >= 0)
        .withColumn("CNT_FAM_MEMBERS", clamp_int("CNT_FAM_MEMBERS"))
        .withColumn("AMT_INCOME_TOTAL", clamp_double("AMT_INCOME_TOTAL"))
    )


def occupation_mode_after_semi_join(app: DataFrame, credit: DataFrame, col: str = "OCCUPATION_TYPE",
                                    key: str = "ID") -> DataFrame:
    """Mode of ``col`` over the applicants that survive the semi-join, duplicates included.

    Rows are pre-aggregated to (key, value, count) before any shuffle, so a hot
    key reaches the semi-join as a handful of rows instead of all its copies.
    """
    counts = app.groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    ids = credit.select(key).distinct()
    kept = counts.join(ids, on=key, how="left_semi")
    per_value = kept.filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum("_n").alias("_n"))
    return per_value.orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).select(
        F.col(col).alias("mode_value"), F.col("_n").alias("mode_count")
    )


def joined_applicants(
    app: DataFrame,
    credit: DataFrame,
    duplicates: str = "keep_first",
    key: str = "ID",
    order_col: str = "ROW_NO",
) -> DataFrame:
    """Key hygiene + join with the reference's semantics, in a skew-safe order.

    The reference semi-joins both ways, takes the occupation mode over the
    surviving applicants (duplicates included), fills, keeps the first row per
    key on both sides and inner-joins.  Semi-joins keep or drop all rows of a
    key together and the fill is row-wise, so both commute with keep-first:
    the plan de-duplicates each side first (a partial aggregate collapses hot
    keys map-side), joins the two ID-partitioned results (which implies both
    semi-joins), and fills with the mode computed on pre-aggregated counts.
    """
    if duplicates == "reject":
        app = dedup_reject(app, key, order_col)
    mode = F.broadcast(occupation_mode_after_semi_join(app, credit, "OCCUPATION_TYPE", key).select("mode_value"))
    app_first = dedup_keep_first(app, key, order_col)
    credit_first = dedup_keep_first(credit, key, order_col).drop(order_col)
    filled = app_first.crossJoin(mode).select(
        *[
            F.coalesce(F.col(c), F.col("mode_value")).alias(c) if c == "OCCUPATION_TYPE" else F.col(c)
            for c in app_first.columns
        ]
    )
    joined = filled.join(credit_first, on=key, how="inner")
    # merge() column order: left columns as they were, then the right side's non-key columns
    return joined.select(*app_first.columns, *[c for c in credit_first.columns if c != key])


def prepared(app: DataFrame, credit: DataFrame, duplicates: str = "keep_first") -> DataFrame:
    """Joined, labelled, filtered and clamped applicant table (one row per ID)."""
    return clean_applicant_columns(add_response(joined_applicants(app, credit, duplicates)))
