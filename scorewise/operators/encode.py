"""Encoding and scaling: one-hot (drop first), z-scores, affine rescale, baskets.

Statistics (levels, means, deviations) are computed in one aggregation pass and
attached as a one-row broadcast, so the transform itself stays a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even

MAX_LEVELS = 10_000


def levels(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column.

    One distributed distinct over (column, value) pairs; at most
    ``len(cols) * (max_levels + 1)`` rows reach the driver, and a column with
    more than ``max_levels`` levels is rejected instead of collected.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("p")
    ).select("p.c", "p.v").filter(F.col("v").isNotNull()).distinct()
    rows = pairs.limit(len(cols) * (max_levels + 1)).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, vals in out.items():
        if len(vals) > max_levels:
            raise ValueError(f"column {c} has more than {max_levels} levels")
        vals.sort()
    return out


def one_hot(
    df: DataFrame,
    cols: list[str],
    drop_first: bool = True,
    known_levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``get_dummies(columns=cols, drop_first=True)``.

    Non-encoded columns keep their order and come first; then ``<col>_<value>``
    int columns per encoded column, levels in lexicographic order, minus the
    first; a null value gives all zeros.
    """
    lv = known_levels or levels(df, cols)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        values = lv[c][1:] if drop_first else lv[c]
        for v in values:
            dummies.append(
                F.when(F.col(f"`{c}`").cast("string") == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}")
            )
    return df.select(*keep, *dummies)


def indicators(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns for features picked by name, without a pass over the data.

    A name is a column of ``df`` or ``<column>_<value>``, the int indicator of
    that value (the longest column name that fits counts); null gives 0, and so
    does a value that never occurs.
    """
    out = []
    for name in names:
        if name in df.columns:
            out.append(F.col(f"`{name}`"))
            continue
        fits = [c for c in df.columns if name.startswith(c + "_")]
        if not fits:
            raise ValueError(f"no column for feature {name}")
        col = max(fits, key=len)
        hit = F.col(f"`{col}`").cast("string") == F.lit(name[len(col) + 1 :])
        out.append(F.when(hit, F.lit(1)).otherwise(F.lit(0)).alias(name))
    return out


def standardize(df: DataFrame, cols: list[str], scale: int | None = 2) -> DataFrame:
    """Z-score with the sample standard deviation, rounded half-even (``scale``)."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(c).alias(f"_s_{i}") for i, c in enumerate(cols)],
    )
    j = df.crossJoin(F.broadcast(stats))
    out = []
    idx = {c: i for i, c in enumerate(cols)}
    for c in df.columns:
        if c in idx:
            i = idx[c]
            z = F.try_divide(F.col(c) - F.col(f"_m_{i}"), F.col(f"_s_{i}"))
            out.append((round_even(z, scale) if scale is not None else z).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return j.select(*out)


def rescale_affine(df: DataFrame, col: str, ref: DataFrame, ref_col: str, name: str, scale: int = 6) -> DataFrame:
    """``x * std(ref) + mean(ref)`` (undo a z-score with another column's moments)."""
    stats = ref.agg(F.avg(ref_col).alias("_m"), F.stddev_samp(ref_col).alias("_s"))
    j = df.crossJoin(F.broadcast(stats))
    return j.select(
        *[c for c in df.columns if c != col], round_even(F.col(col) * F.col("_s") + F.col("_m"), scale).alias(name)
    )


def baskets(
    df: DataFrame,
    cols: list[str],
    id_col: str = "ID",
    known_levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Item baskets: one item ``<col>_<value>`` per column, except each column's first level.

    First levels are a one-row aggregate joined to the rows, so a column may
    have any number of levels; ``known_levels`` (sorted) spares that pass.
    """
    if known_levels is None:
        firsts = df.agg(*[F.min(F.col(f"`{c}`").cast("string")).alias(f"_first_{i}") for i, c in enumerate(cols)])
        rows = df.crossJoin(F.broadcast(firsts))
        first = [F.col(f"_first_{i}") for i in range(len(cols))]
    else:
        cols = [c for c in cols if known_levels[c]]
        rows, first = df, [F.lit(known_levels[c][0]) for c in cols]
    value = [F.col(f"`{c}`").cast("string") for c in cols]
    items = [F.when(v != f, F.concat(F.lit(f"{c}_"), v)) for c, v, f in zip(cols, value, first)]
    return rows.select(F.col(id_col).alias("id"), F.array_compact(F.array(*items)).alias("items"))
