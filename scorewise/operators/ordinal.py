"""Order-dependent operators without a single-partition window.

A global position (or running total) is computed in three distributed steps:

1. rows are cut into ordered buckets (``Bucketizer`` over approximate quantile
   cut points of the ordering column, or a fixed bucket for a uniform hash);
2. a window *per bucket* gives the local position / running total, so no task
   ever holds more than one bucket;
3. a small table of per-bucket totals (one row per bucket) is turned into
   offsets and joined back.

A hot group is split across many buckets, so it never lands in one task.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.session import cut_lineage

DEFAULT_ROWS_PER_BUCKET = 500_000
#: Buckets at least, so that small and large inputs take the same plan.
MIN_BUCKETS = 4
_BUCKET = "_sw_bucket"


def _bucketed(df: DataFrame, order_col: str, rows_per_bucket: int | None) -> DataFrame:
    rows_per_bucket = rows_per_bucket or DEFAULT_ROWS_PER_BUCKET
    nb = max(MIN_BUCKETS, math.ceil(df.count() / rows_per_bucket))
    probs = [i / nb for i in range(1, nb)]
    cuts = df.approxQuantile(order_col, probs, 1.0 / (4 * nb))
    splits = [-math.inf] + sorted({float(c) for c in cuts if c is not None}) + [math.inf]
    tmp = "_sw_order_d"
    out = df.withColumn(tmp, F.col(order_col).cast("double"))
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol=_BUCKET, handleInvalid="keep").transform(out)
    # rows without an order key come first, as in an ascending sort; NaN has the last bucket
    return out.withColumn(_BUCKET, F.when(F.col(tmp).isNull(), F.lit(-1.0)).otherwise(F.col(_BUCKET))).drop(tmp)


def running_totals(
    df: DataFrame,
    order_cols: list[str],
    values: dict[str, Column],
    group_cols: tuple[str, ...] | list[str] = (),
    inclusive: bool = True,
    descending: bool = False,
    rows_per_bucket: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Add running sums of ``values`` in ``order_cols`` order within ``group_cols``.

    ``order_cols[0]`` must be numeric; the full ``order_cols`` list should be
    unique within a group for a deterministic result.  Null order keys come
    first; null group keys form a group.  The input is read three
    times (count, cut points, windows); pass ``materialize=True`` when it is an
    expensive plan so it is checkpointed once instead of recomputed.
    """
    group_cols = list(group_cols)
    first = order_cols[0]
    work = cut_lineage(df) if materialize else df
    if descending:
        work = work.withColumn("_sw_neg", -F.col(first).cast("double"))
        key = ["_sw_neg"] + order_cols[1:]
        orders = [F.col("_sw_neg")] + [F.col(c).desc() for c in order_cols[1:]]
    else:
        key = order_cols
        orders = [F.col(c) for c in order_cols]
    work = _bucketed(work, key[0], rows_per_bucket)
    tmp = {name: f"_sw_v_{i}" for i, name in enumerate(values)}
    for name, expr in values.items():
        work = work.withColumn(tmp[name], expr)

    frame_end = Window.currentRow if inclusive else -1
    w_local = Window.partitionBy(*group_cols, _BUCKET).orderBy(*orders).rowsBetween(
        Window.unboundedPreceding, frame_end
    )
    for name in values:
        work = work.withColumn(f"_sw_l_{tmp[name]}", F.coalesce(F.sum(tmp[name]).over(w_local), F.lit(0)))

    totals = work.groupBy(*group_cols, _BUCKET).agg(
        *[F.sum(tmp[name]).alias(f"_sw_t_{tmp[name]}") for name in values]
    )
    w_off = Window.partitionBy(*group_cols).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols,
        _BUCKET,
        *[
            F.coalesce(F.sum(f"_sw_t_{tmp[name]}").over(w_off), F.lit(0)).alias(f"_sw_o_{tmp[name]}")
            for name in values
        ],
    )
    right = offsets.withColumnsRenamed({c: f"_sw_g_{i}" for i, c in enumerate(group_cols)} | {_BUCKET: "_sw_b"})
    hit = F.col(_BUCKET) == F.col("_sw_b")
    for i, c in enumerate(group_cols):
        hit = hit & F.col(c).eqNullSafe(F.col(f"_sw_g_{i}"))
    joined = work.join(right, hit)
    for name in values:
        joined = joined.withColumn(name, F.col(f"_sw_o_{tmp[name]}") + F.col(f"_sw_l_{tmp[name]}"))
    drop = [_BUCKET] + [c for c in joined.columns if c.startswith("_sw_") and c not in values]
    return joined.drop(*drop)


def with_row_index(
    df: DataFrame,
    order_cols: list[str] | str,
    name: str = "row_idx",
    group_cols: tuple[str, ...] | list[str] = (),
    rows_per_bucket: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``group_cols``)."""
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    out = running_totals(
        df, list(order_cols), {name: F.lit(1).cast("long")}, group_cols, inclusive=False,
        rows_per_bucket=rows_per_bucket, materialize=materialize,
    )
    return out.withColumn(name, F.col(name).cast("long"))


def sample_every_k(df: DataFrame, k: int, order_col: str = "ROW_NO") -> DataFrame:
    """Positional ``df[::k]``: rows 0, k, 2k, ... in ``order_col`` order."""
    idx = with_row_index(df, order_col, "_sw_pos")
    return idx.filter(F.col("_sw_pos") % k == 0).drop("_sw_pos")


def with_file_row_no(df: DataFrame, name: str = "ROW_NO") -> DataFrame:
    """File-order ordinal for a file scan: (file, block start, row within block)."""
    keyed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_sw_file"),
        F.col("_metadata.file_block_start").alias("_sw_block"),
        F.monotonically_increasing_id().alias("_sw_mid"),
    )
    w_local = Window.partitionBy("_sw_file", "_sw_block").orderBy("_sw_mid")
    keyed = keyed.withColumn("_sw_local", F.row_number().over(w_local) - 1)
    blocks = keyed.groupBy("_sw_file", "_sw_block").agg(F.count(F.lit(1)).alias("_sw_n"))
    w_off = Window.orderBy("_sw_file", "_sw_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_sw_off", F.coalesce(F.sum("_sw_n").over(w_off), F.lit(0)))
    out = keyed.join(blocks.drop("_sw_n"), ["_sw_file", "_sw_block"])
    out = out.withColumn(name, (F.col("_sw_off") + F.col("_sw_local")).cast("long"))
    return out.drop("_sw_file", "_sw_block", "_sw_mid", "_sw_local", "_sw_off")
