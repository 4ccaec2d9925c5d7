"""Table profiling: counts, distinct counts, nulls, distributions, moments.

Wide per-column statistics are computed in one ``agg`` pass and returned in
long form (one row per column) with ``stack``-like unions of literals, so the
result schema does not depend on the number of columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewise.functions.scalar import round_even
from scorewise.operators.ordinal import running_totals
from scorewise.session import cut_lineage


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def select_non_numeric(df: DataFrame) -> DataFrame:
    """``select_dtypes(exclude='number')``."""
    return df.select(*non_numeric_columns(df))


def _long_form(wide: DataFrame, names: list[str], value_type: str, prefix: str, value_name: str) -> DataFrame:
    """One-row wide table ``{prefix}{i}`` -> rows (ordinal, column, value)."""
    entries = ", ".join(
        f"{i}, '{n}', CAST(`{prefix}{i}` AS {value_type})" for i, n in enumerate(names)
    )
    return wide.selectExpr(f"stack({len(names)}, {entries}) AS (ordinal, column_name, {value_name})")


def profile_info(df: DataFrame) -> DataFrame:
    """``df.info()``: column, dtype, non-null count."""
    names = df.columns
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)])
    out = _long_form(wide, names, "BIGINT", "_c", "non_null")
    types = {c: t for c, t in df.dtypes}
    dtype = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(types[c]))])
    return out.withColumn("dtype", dtype[F.col("column_name")])


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long")
    )


def nunique(df: DataFrame, approx: bool = False) -> DataFrame:
    """``df.nunique()``: distinct non-null values per column."""
    names = df.columns
    fn = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(*[fn(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)])
    return _long_form(wide, names, "BIGINT", "_c", "n_unique")


def null_counts(df: DataFrame) -> DataFrame:
    """``isna().sum()`` and ``isna().sum() / shape[0]`` per column."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_c{i}") for i, c in enumerate(names)],
    )
    out = _long_form(wide.drop("_rows"), names, "BIGINT", "_c", "null_count")
    rows = wide.select("_rows")
    return (
        out.crossJoin(F.broadcast(rows))
        .withColumn("null_ratio", round_even(F.try_divide(F.col("null_count").cast("double"), F.col("_rows")), 6))
        .drop("_rows")
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``value_counts()``: value, count, descending (ties by value)."""
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col(col).isNotNull())
        .orderBy(F.col("count").desc(), F.col(col))
    )


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """Category histogram (count plot) over one or two columns."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def mean_std(df: DataFrame, cols: list[str], scale: int = 6) -> DataFrame:
    """Column mean and sample standard deviation (ddof = 1), long form."""
    wide = df.agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(cols)],
    )
    rows = ", ".join(f"'{c}', `_m{i}`, `_s{i}`" for i, c in enumerate(cols))
    out = wide.selectExpr(f"stack({len(cols)}, {rows}) AS (column_name, mean, std)")
    return out.select(
        "column_name", round_even("mean", scale).alias("mean"), round_even("std", scale).alias("std")
    )


def _pair_merge(a, b):
    """Chan et al. merge of pairwise-complete statistics (all p×p arrays).

    mean[i, j] / m2[i, j] are the mean / centred sum of squares of column i over
    the rows where both i and j are present; cxy[i, j] is their co-moment.
    """
    na, ma, qa, ca = a
    nb, mb, qb, cb = b
    n = na + nb
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(n > 0, na * nb / n, 0.0)
        frac = np.where(n > 0, nb / n, 0.0)
    d = mb - ma
    mean = ma + d * frac
    m2 = qa + qb + d * d * w
    cxy = ca + cb + d * d.T * w
    return n, mean, m2, cxy


def _pair_partials(cols: list[str]):
    p = len(cols)

    def run(batches):
        import pandas as pd

        acc = None
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            if not len(x):
                continue
            mask = ~np.isnan(x)
            m = mask.astype(float)
            n = m.T @ m
            with np.errstate(invalid="ignore", divide="ignore"):
                shift = np.where(mask.any(0), np.nanmean(x, axis=0), 0.0)
            xc = np.where(mask, x - shift, 0.0)
            s = xc.T @ m  # s[i, j]: sum of (x_i - shift_i) over rows with i and j present
            with np.errstate(invalid="ignore", divide="ignore"):
                mean_c = np.where(n > 0, s / n, 0.0)
            q = (xc * xc).T @ m - n * mean_c * mean_c
            c = xc.T @ xc - n * mean_c * mean_c.T
            part = (n, mean_c + shift[:, None], q, c)
            acc = part if acc is None else _pair_merge(acc, part)
        if acc is not None:
            yield pd.DataFrame({k: [v.ravel().tolist()] for k, v in zip(("n", "mean", "m2", "cxy"), acc)})

    return run


def _pair_merge_rows(p: int):
    def run(batches):
        import pandas as pd

        acc = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                part = tuple(np.asarray(getattr(r, k), dtype=float).reshape(p, p) for k in ("n", "mean", "m2", "cxy"))
                acc = part if acc is None else _pair_merge(acc, part)
        if acc is not None:
            yield pd.DataFrame({k: [v.ravel().tolist()] for k, v in zip(("n", "mean", "m2", "cxy"), acc)})

    return run


MAX_PAIR_PARTIALS = 16


def pairwise(df: DataFrame, cols: list[str], kind: str = "corr", scale: int = 1) -> DataFrame:
    """Pearson correlation (``corr``) or sample covariance (``cov``) matrix, long form.

    Pairwise-complete (each pair ignores rows where either value is null), as
    ``DataFrame.corr`` / ``cov``.  One pass: each partition reduces its rows to
    p×p pairwise counts, means, sums of squares and co-moments in numpy; the
    partials are tree-merged (Chan et al.) so the driver receives a bounded
    number of p×p summaries.  A constant column gives null, not an error.
    """
    p = len(cols)
    schema = "n array<double>, mean array<double>, m2 array<double>, cxy array<double>"
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    partials = data.mapInPandas(_pair_partials(list(cols)), schema)
    # one merge step at every size: the input is read once, the driver gets MAX_PAIR_PARTIALS summaries at most
    partials = partials.repartition(MAX_PAIR_PARTIALS).mapInPandas(_pair_merge_rows(p), schema)
    acc = None
    for r in partials.collect():
        part = tuple(np.asarray(r[k], dtype=float).reshape(p, p) for k in ("n", "mean", "m2", "cxy"))
        acc = part if acc is None else _pair_merge(acc, part)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if acc is None:
                val = None
            else:
                n, _, m2, cxy = acc
                if kind == "corr":
                    den = m2[i, j] * m2[j, i]
                    val = float(cxy[i, j] / np.sqrt(den)) if n[i, j] > 1 and den > 0 else None
                else:
                    val = float(cxy[i, j] / (n[i, j] - 1)) if n[i, j] > 1 else None
            rows.append((a, b, val))
    out = df.sparkSession.createDataFrame(rows, f"col_a string, col_b string, {kind} double")  # p² rows
    return out.select("col_a", "col_b", round_even(kind, scale).alias(kind))


def gram_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """XᵀX, Xᵀ1 and n in long form (row_name, col_name, value); one pass."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"_g{i}_{j}") for i, j in pairs]
    aggs += [F.sum(F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)]
    aggs.append(F.count(F.lit(1)).cast("double").alias("_n"))
    wide = df.agg(*aggs)
    entries = []
    for i, j in pairs:
        entries.append(f"'{cols[i]}', '{cols[j]}', `_g{i}_{j}`")
        if i != j:
            entries.append(f"'{cols[j]}', '{cols[i]}', `_g{i}_{j}`")
    for i, c in enumerate(cols):
        entries.append(f"'{c}', '1', `_s{i}`")
    entries.append("'1', '1', `_n`")
    return wide.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (row_name, col_name, value)")


def value_counts_table(df: DataFrame, value_col: str, group_cols: list[str]) -> DataFrame:
    """(group, value, count) of the non-null values, checkpointed (read several times)."""
    counts = (
        df.filter(F.col(value_col).isNotNull())
        .groupBy(*group_cols, F.col(value_col).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return cut_lineage(counts)


def quantiles_from_counts(counts: DataFrame, group_cols: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles from a (group, _v, _c) table."""
    ranked = running_totals(counts, ["_v"], {"_below": F.col("_c")}, group_cols, inclusive=False)
    sizes = counts.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    pos = sizes
    for k, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        pos = pos.withColumn(f"_lo{k}", F.floor(h).cast("long")).withColumn(f"_fr{k}", h - F.floor(h))
    joined = ranked.join(pos, on=group_cols, how="inner") if group_cols else ranked.crossJoin(F.broadcast(pos))

    def covers(position):
        return (F.col("_below") <= position) & (position < F.col("_below") + F.col("_c"))

    aggs = []
    keep = F.lit(False)
    for k, _ in enumerate(probs):
        lo_pos, hi_pos = F.col(f"_lo{k}"), F.least(F.col(f"_lo{k}") + 1, F.col("_n") - 1)
        lo = F.max(F.when(covers(lo_pos), F.col("_v")))
        hi = F.max(F.when(covers(hi_pos), F.col("_v")))
        fr = F.max(F.col(f"_fr{k}"))
        aggs.append((lo + F.coalesce(fr * (hi - lo), F.lit(0.0))).alias(f"q{k}"))
        keep = keep | covers(lo_pos) | covers(hi_pos)
    return joined.filter(keep).groupBy(*group_cols).agg(*aggs, F.max("_n").alias("n"))


def exact_quantiles(df: DataFrame, value_col: str, group_cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy default), per group.

    Distributed and tie-safe: rows are first reduced to (group, value, count)
    — a hot or heavily tied value collapses map-side — then each distinct value
    gets the number of rows below it through bucketed running totals, and only
    the values covering the two positions around each quantile are kept.
    """
    return quantiles_from_counts(value_counts_table(df, value_col, group_cols), group_cols, probs)


def box_stats(df: DataFrame, value_col: str, group_cols: list[str], scale: int = 6) -> DataFrame:
    """Five-number summary per group: Q1, median, Q3, whiskers within 1.5·IQR, outliers.

    The input is read once: quantiles, whiskers and outlier counts all come
    from the checkpointed (group, value, count) table.
    """
    counts = value_counts_table(df, value_col, group_cols)
    q = quantiles_from_counts(counts, group_cols, [0.25, 0.5, 0.75]).select(
        *group_cols, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    q = q.withColumn("_lof", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hif", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    j = counts.join(q, on=group_cols, how="inner") if group_cols else counts.crossJoin(F.broadcast(q))
    inside = (F.col("_v") >= F.col("_lof")) & (F.col("_v") <= F.col("_hif"))
    agg = j.groupBy(*group_cols).agg(
        F.max("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_c")).otherwise(F.lit(0))).alias("n_outliers"),
    )
    return agg.select(
        *group_cols,
        "n",
        *[round_even(c, scale).alias(c) for c in ["q1", "median", "q3", "whisker_low", "whisker_high"]],
        "n_outliers",
    )


def unpivot(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Wide -> long (column_name, value) over ``cols``."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(keep), cols, "column_name", "value") if keep else casted.unpivot(
        [], cols, "column_name", "value"
    )


def box_stats_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Box statistics for every feature column (``boxplot(data=df[cols])``)."""
    return box_stats(unpivot(df, cols), "value", ["column_name"])


def iqr_filter(df: DataFrame, col: str) -> DataFrame:
    """Keep rows strictly inside the 1.5·IQR fences of ``col``; unchanged if none survive.

    Fences and the survivor count come from the (value, count) table; the input
    itself is read once more only to emit the kept rows.
    """
    counts = value_counts_table(df, col, [])
    q = quantiles_from_counts(counts, [], [0.25, 0.75]).select(
        (F.col("q0") - 1.5 * (F.col("q1") - F.col("q0"))).alias("_lof"),
        (F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("_hif"),
    )
    fences = q.crossJoin(
        counts.crossJoin(F.broadcast(q))
        .agg(F.sum(F.when((F.col("_v") > F.col("_lof")) & (F.col("_v") < F.col("_hif")), F.col("_c")).otherwise(0)).alias("_k"))
    )
    j = df.crossJoin(F.broadcast(fences))  # one row
    inside = (F.col(col) > F.col("_lof")) & (F.col(col) < F.col("_hif"))
    return j.filter(inside | (F.col("_k") == 0)).drop("_lof", "_hif", "_k")
