"""Singular values of tall matrices by a tree of QR factorisations.

Each partition folds its rows into one triangular factor R, batch by batch; the
rows of all factors are factorised again in a bounded number of tasks, and the
driver takes the singular values of the last few.  The matrix is never
multiplied with itself, so a condition number isn't squared on the way: values
are right to about 1e-16 of the largest one, where the Gram matrix of the data
loses everything below 1e-8 of it.

Rows with a null component are left out, as the moments do.  No rows, or no
columns, have no singular values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even

MAX_TASKS = 16
#: Rows that are factorised at once.
SLICE_ROWS = 4096


def _factor(p: int):
    """Fold rows of ``p`` numbers into the rows of one R."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for at in range(0, len(x), SLICE_ROWS):
                r = np.linalg.qr(np.vstack([r, x[at : at + SLICE_ROWS]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["x"])

    return run


def row_vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def r_factor(df: DataFrame, x: Column, p: int) -> np.ndarray:
    """R of the matrix whose rows are the arrays ``x`` of ``p`` numbers; at most ``p`` rows."""
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    fold = _factor(p)
    top = rows.mapInArrow(fold, "x array<double>").repartition(MAX_TASKS).mapInArrow(fold, "x array<double>").collect()
    return np.linalg.qr(np.array([r["x"] for r in top], float).reshape(-1, p), mode="r")


def singular_values(df: DataFrame, x: Column, p: int) -> np.ndarray:
    """Singular values, largest first: ``p`` of them, or as many as there are rows."""
    r = r_factor(df, x, p)
    return np.linalg.svd(r, compute_uv=False) if r.size else np.zeros(0)


def condition_number(df: DataFrame, x: Column, p: int) -> float | None:
    """Largest over smallest singular value; infinite for a singular matrix, null without rows."""
    s = singular_values(df, x, p)
    if not len(s):
        return None
    return math.inf if s[-1] == 0.0 else float(s[0] / s[-1])


def condition_table(spark: SparkSession, matrices: dict[str, tuple[DataFrame, Column, int]], scale: int = 3) -> DataFrame:
    """(matrix, n_columns, condition_number), one row per named matrix."""
    rows = [(name, p, condition_number(df, x, p)) for name, (df, x, p) in matrices.items()]
    out = spark.createDataFrame(rows, "matrix STRING, n_columns INT, condition_number DOUBLE")
    cond = F.col("condition_number")
    return out.select("matrix", "n_columns", F.when(cond == math.inf, cond).otherwise(round_even("condition_number", scale)).alias("condition_number"))
