"""Splits, stratified folds and SMOTE balancing — all deterministic from ids.

No ``rand()``: every random choice is a pure function of a row id and a seed,
so results do not change with partitioning or after a task retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.functions.scalar import SPLIT_MODULUS, SPLIT_MULTIPLIER
from scorewise.operators.neighbors import knn_join
from scorewise.operators.ordinal import with_row_index

# Multipliers of the arithmetic draws used by SMOTE (chosen so the
# DuckDB oracle can evaluate the same draw).
SMOTE_U_MULT_ID = 7919
SMOTE_U_MULT_COPY = 104729
SMOTE_U_RESOLUTION = 1000


def shuffle_key(id_col: str, seed: int):
    """A pseudo-random but reproducible ordering key of an integer id."""
    return F.pmod(
        F.pmod(F.col(id_col).cast("long"), F.lit(SPLIT_MODULUS)) * F.lit(SPLIT_MULTIPLIER) + F.lit(int(seed)),
        F.lit(SPLIT_MODULUS),
    )


def stratified_folds(df: DataFrame, label_col: str, id_col: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold number per row: rank within its class in shuffled order, modulo k.

    Fold sizes differ by at most one per class.  Ranks come from the bucketed
    running count, so a class holding most rows is still split across tasks.
    """
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed))
    ranked = with_row_index(keyed, ["_sk", id_col], "_rk", group_cols=[label_col])
    return ranked.withColumn(name, (F.col("_rk") % k).cast("int")).drop("_sk", "_rk")


def smote(
    df: DataFrame,
    label_col: str = "label",
    id_col: str = "id",
    vec_col: str = "v",
    k: int = 5,
    seed: int = 5805,
) -> DataFrame:
    """Raise every smaller class to the majority count with synthetic rows.

    A synthetic row is ``x + u * (nn - x)`` where ``x`` is a minority row, ``nn``
    one of its ``k`` nearest same-class neighbours (exact k-NN join) and
    ``u`` in [0, 1).  Base rows are used round-robin in id order; neighbour
    rank and ``u`` are arithmetic draws of (id, copy index, seed).  A class with
    fewer than ``k + 1`` rows uses the neighbours it has; the copies of a class
    of one row are that row, which is its own neighbour.

    Output columns: ``id`` (the base row's id for synthetic rows), ``label``,
    ``v``, ``synthetic``, ``copy`` (null for originals), ``neighbor_id``, ``u``.
    """
    counts = {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}  # one row per class
    top = max(counts.values())
    need = {c: top - n for c, n in counts.items() if n < top}
    base = df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"),
        F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("copy"),
        F.lit(None).cast("long").alias("neighbor_id"), F.lit(None).cast("double").alias("u"),
    )
    if not need:
        return base
    near = {c: min(k, counts[c] - 1) for c in need}
    spark = df.sparkSession
    plan = F.broadcast(
        spark.createDataFrame(
            [(c, counts[c], n, near[c]) for c, n in need.items()],
            f"label {dict(df.dtypes)[label_col]}, _m long, _need long, _k long",
        )
    )
    mins = base.select("id", "label", "v").join(plan, "label")
    ranked = with_row_index(mins, ["id"], "_r", group_cols=["label"])
    copies = F.floor(F.col("_need") / F.col("_m")) + (F.col("_r") < F.col("_need") % F.col("_m")).cast("long")
    ex = ranked.withColumn("_n", copies).filter("_n > 0").withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    ex = ex.withColumn("copy", F.col("_r") + F.col("_t") * F.col("_m"))
    ex = ex.withColumn(
        "u",
        F.pmod(
            F.col("id") * SMOTE_U_MULT_ID + F.col("copy") * SMOTE_U_MULT_COPY + F.lit(int(seed)),
            F.lit(SMOTE_U_RESOLUTION),
        ).cast("double") / float(SMOTE_U_RESOLUTION),
    )
    picked = ex.filter("_k = 0").withColumn("neighbor_id", F.col("id"))
    if max(near.values()) > 0:
        pairs = knn_join(mins, mins, max(near.values()), "id", "v", group_col="label", exclude_self=True)
        nn = pairs.select(F.col("qid").alias("id"), F.col("rank").cast("long").alias("_nr"), F.col("nid").alias("neighbor_id"))
        drawn = ex.filter("_k > 0").withColumn("_nr", F.pmod(F.col("id") + F.col("copy"), F.col("_k")) + 1)
        picked = picked.unionByName(drawn.join(nn, ["id", "_nr"]).drop("_nr"))
    nvec = base.select(F.col("id").alias("neighbor_id"), F.col("v").alias("_nv"))
    syn = picked.join(nvec, "neighbor_id").select(
        "id", "label",
        F.zip_with("v", "_nv", lambda a, b: a + F.col("u") * (b - a)).alias("v"),
        F.lit(True).alias("synthetic"), "copy", "neighbor_id", "u",
    )
    return base.unionByName(syn)
