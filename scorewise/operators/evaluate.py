"""Classification metrics over a prediction table (label, prediction[, score]).

All metrics are conditional sums in one aggregation pass; ROC / AUC group by
distinct score first and then use distributed running totals, so no task
sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even
from scorewise.operators.ordinal import running_totals


def _counts(df: DataFrame, label: str, prediction: str, positive: float = 1.0) -> DataFrame:
    y = F.col(label) == F.lit(positive)
    p = F.col(prediction) == F.lit(positive)
    return df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows = true label, columns = predicted 0 / 1."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(prediction) == 0).alias("pred_0"),
        F.count_if(F.col(prediction) == 1).alias("pred_1"),
    )


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", scale: int | None = 6
) -> DataFrame:
    """accuracy, precision, recall, f1 (class 1; 0 when undefined) and specificity."""
    c = _counts(df, label, prediction)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision = _safe(tp, tp + fp)
    recall = _safe(tp, tp + fn)
    out = c.select(
        _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _safe(2 * precision * recall, precision + recall).alias("f1"),
        _safe(tn, tn + fp).alias("specificity"),
    )
    if scale is None:
        return out
    return out.select(*[round_even(c, scale).alias(c) for c in out.columns])


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(round_even(F.avg((F.col(label) == F.col(prediction)).cast("double")), 6).alias("accuracy"))


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"),
        F.count_if(F.col(label) != 1).cast("double").alias("neg"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", scale: int = 6) -> DataFrame:
    """All ROC points: one per distinct score (descending) plus the (inf, 0, 0) start."""
    g = _score_groups(df, label, score)
    tot = df.agg(
        F.count_if(F.col(label) == 1).cast("double").alias("P"),
        F.count_if(F.col(label) != 1).cast("double").alias("N"),
    )
    cum = running_totals(
        g, ["threshold"], {"tp": F.col("pos"), "fp": F.col("neg")}, inclusive=True, descending=True,
        materialize=True,
    )
    pts = cum.crossJoin(F.broadcast(tot)).select(
        "threshold",
        round_even(F.try_divide(F.col("fp"), F.col("N")), scale).alias("fpr"),
        round_even(F.try_divide(F.col("tp"), F.col("P")), scale).alias("tpr"),
    )
    start = tot.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def scored_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """accuracy, precision, recall, f1, specificity and auc from one pass over the predictions.

    The pass counts the outcomes of every distinct score; the six numbers are
    sums over that table, which is materialised once.
    """
    from scorewise.session import cut_lineage

    y, p = F.col(label) == 1, F.col(prediction) == 1
    groups = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(y).cast("double").alias("pos"), F.count_if(F.col(label) != 1).cast("double").alias("neg"),
    )
    groups = cut_lineage(groups)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    sums = groups.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")]).select(
        _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _safe(2 * precision * recall, precision + recall).alias("f1"), _safe(tn, tn + fp).alias("specificity"),
    )
    return sums.crossJoin(_area(groups.select("threshold", "pos", "neg"), materialize=False))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> Column | DataFrame:
    """Area under the ROC curve (trapezoid; ties count one half), distributed."""
    return _area(_score_groups(df, label, score), materialize=True)


def _area(groups: DataFrame, materialize: bool) -> DataFrame:
    cum = running_totals(
        groups, ["threshold"], {"tp_before": F.col("pos")}, inclusive=False, descending=True, materialize=materialize
    )
    return cum.agg(
        F.try_divide(
            F.sum(F.col("neg") * (F.col("tp_before") + F.col("pos") / 2.0)),
            F.sum("pos") * F.sum("neg"),
        ).alias("auc")
    )


def leaderboard(predictions: dict[str, DataFrame], label: str = "label", prediction: str = "prediction",
                scale: int = 3) -> DataFrame:
    """One metrics row per model (accuracy, precision, recall, f1, specificity)."""
    rows = None
    for name, df in predictions.items():
        m = binary_metrics(df, label, prediction, scale=None).select(F.lit(name).alias("model"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows.select("model", *[round_even(c, scale).alias(c) for c in rows.columns if c != "model"])
