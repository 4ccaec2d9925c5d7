"""Sufficient statistics (one Gram pass) and everything that rests on them.

``moments`` reads the data once: each partition reduces its rows to a count,
a mean vector and a centred scatter matrix, and the driver merges those
p×p summaries (one per partition).  PCA, truncated SVD, condition numbers, VIF and OLS with backward
elimination are then solved on the p×p summary without further passes, and
their small result tables are returned as DataFrames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewise.functions.scalar import round_even
from scorewise.functions.stats import t_quantile, t_two_sided_p

CONST = "const"


@dataclass
class Moments:
    cols: list[str]
    n: float
    mean: np.ndarray
    csum: np.ndarray  # Σ (x - mean)(x - mean)ᵀ

    def index(self, name: str) -> int:
        return self.cols.index(name)

    def uncentered(self, names: list[str]) -> np.ndarray:
        """XᵀX over ``names`` (``const`` is the all-ones column)."""
        k = len(names)
        g = np.empty((k, k))
        for a, na in enumerate(names):
            for b, nb in enumerate(names):
                if na == CONST and nb == CONST:
                    g[a, b] = self.n
                elif na == CONST:
                    g[a, b] = self.n * self.mean[self.index(nb)]
                elif nb == CONST:
                    g[a, b] = self.n * self.mean[self.index(na)]
                else:
                    i, j = self.index(na), self.index(nb)
                    g[a, b] = self.csum[i, j] + self.n * self.mean[i] * self.mean[j]
        return g

    def centered(self, names: list[str]) -> np.ndarray:
        idx = [self.index(c) for c in names]
        return self.csum[np.ix_(idx, idx)]


def _partition_moments(cols: list[str]):
    """Per-partition count, mean and centred scatter (numpy on Arrow batches)."""

    def run(batches):
        import pandas as pd

        n, mean, scatter = 0.0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            if not len(x):
                continue
            nb = float(len(x))
            mb = x.mean(axis=0)
            xc = x - mb
            sb = xc.T @ xc
            delta = mb - mean
            tot = n + nb
            scatter = scatter + sb + np.outer(delta, delta) * (n * nb / tot)
            mean = mean + delta * (nb / tot)
            n = tot
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    return run


def _merge_partials(p: int):
    """Merge (n, mean, scatter) rows of a batch into one (Chan et al.)."""

    def run(batches):
        import pandas as pd

        n, mean, scatter = 0.0, np.zeros(p), np.zeros((p, p))
        for pdf in batches:
            for nb, mb, sb in zip(pdf["n"], pdf["mean"], pdf["scatter"]):
                mb, sb = np.asarray(mb, dtype=float), np.asarray(sb, dtype=float).reshape(p, p)
                delta = mb - mean
                tot = n + nb
                scatter = scatter + sb + np.outer(delta, delta) * (n * nb / tot)
                mean = mean + delta * (nb / tot)
                n = tot
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    return run


MAX_PARTIALS = 16


def moments(df: DataFrame, cols: list[str]) -> Moments:
    """Count, means and centred cross products of ``cols`` over complete rows.

    One pass: every partition reduces its rows to (n, mean, scatter) in numpy
    (p + p² numbers).  The partials are merged in Spark first (a tree
    step down to ``MAX_PARTIALS`` rows), so the driver
    only ever receives a bounded number of p×p summaries, which it merges with
    the pairwise update of Chan et al. — stable, no second scan.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    schema = "n double, mean array<double>, scatter array<double>"
    p = len(cols)
    partials = data.mapInPandas(_partition_moments(list(cols)), schema)
    # one merge step at every size: the input is read once, the driver gets MAX_PARTIALS summaries at most
    partials = partials.repartition(MAX_PARTIALS).mapInPandas(_merge_partials(p), schema)
    parts = partials.collect()
    n, mean, scatter = 0.0, np.zeros(p), np.zeros((p, p))
    for r in parts:
        nb, mb, sb = float(r["n"]), np.array(r["mean"]), np.array(r["scatter"]).reshape(p, p)
        delta = mb - mean
        tot = n + nb
        scatter = scatter + sb + np.outer(delta, delta) * (n * nb / tot)
        mean = mean + delta * (nb / tot)
        n = tot
    return Moments(list(cols), n, mean, scatter)


def add_constant(df: DataFrame, cols: list[str], name: str = CONST) -> DataFrame:
    """Prepend-free ``add_constant``: add ``const = 1.0`` unless a column is already constant."""
    row = df.agg(*[(F.min(c) == F.max(c)).alias(f"_k{i}") for i, c in enumerate(cols)]).first()
    if any(row[f"_k{i}"] for i in range(len(cols))):
        return df
    return df.withColumn(name, F.lit(1.0))


# --------------------------------------------------------------------------- PCA / SVD

def signed(vecs: np.ndarray) -> np.ndarray:
    """``vecs`` with the largest loading of each column (the first of equal ones) made positive."""
    top = np.abs(vecs).round(12).argmax(axis=0)
    return vecs * np.where(vecs[top, np.arange(vecs.shape[1])] < 0, -1.0, 1.0)


def pca_spectrum(m: Moments, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors of the sample covariance of ``cols``."""
    cov = m.centered(cols) / (m.n - 1.0)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    return np.clip(vals[order], 0.0, None), signed(vecs[:, order])


def variance_table(spark: SparkSession, variances: list[float], ratios: list[float], scale: int = 6) -> DataFrame:
    """(component, explained_variance, ratio, cumulative) with a running-sum window.

    The table has one row per component (p rows), so the unpartitioned window
    is bounded by the feature count.
    """
    rows = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(variances, ratios))]
    schema = "component INT, explained_variance DOUBLE, ratio DOUBLE"
    df = spark.createDataFrame(rows, schema)
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "component",
        round_even("explained_variance", scale).alias("explained_variance"),
        round_even("ratio", scale).alias("ratio"),
        round_even(F.sum("ratio").over(w), scale).alias("cumulative"),
    )


def pca_table(spark: SparkSession, m: Moments, cols: list[str]) -> DataFrame:
    vals, _ = pca_spectrum(m, cols)
    total = float(vals.sum())
    return variance_table(spark, list(vals), [v / total if total else math.nan for v in vals])


def components_for(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Smallest component count whose cumulative ratio reaches ``threshold`` (null if none)."""
    return table.agg(F.min(F.when(F.col("cumulative") >= threshold, F.col("component"))).alias("n_components"))


def project(df: DataFrame, cols: list[str], centre: np.ndarray, axes: np.ndarray, prefix: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` and (x - centre) @ axes: one matrix product per Arrow batch, however many columns and axes.

    A row with a null among ``cols`` gets nulls.
    """
    import pyarrow as pa

    k = axes.shape[1]
    keep = list(keep)
    outs = [f"{prefix}{i + 1}" for i in range(k)]

    def run(batches):
        for batch in batches:
            flat = batch.column("_x").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(cols))
            gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(axis=1)
            y = (x - centre) @ axes
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(y[:, i], mask=gone) for i in range(k))], [*keep, *outs])

    fields = df.select(*keep).schema.fields + [T.StructField(c, T.DoubleType()) for c in outs]
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).mapInArrow(run, T.StructType(fields))


def pca_project(df: DataFrame, m: Moments, cols: list[str], k: int, keep: list[str] = ()) -> DataFrame:
    """Centred rows on the top-k principal axes, ``pc1`` to ``pck``."""
    _, vecs = pca_spectrum(m, cols)
    return project(df, cols, m.mean[[m.index(c) for c in cols]], vecs[:, :k], "pc", keep)


def svd_spectrum(m: Moments, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right singular vectors of the uncentred X (descending), and TruncatedSVD's
    variance / ratio per component (population variance of the projection)."""
    g = m.uncentered(cols)
    vals, vecs = np.linalg.eigh(g)
    order = np.argsort(vals)[::-1]
    vecs = signed(vecs[:, order])
    s_pop = m.centered(cols) / m.n
    var = np.array([float(vecs[:, i] @ s_pop @ vecs[:, i]) for i in range(len(cols))])
    total = float(np.trace(s_pop))
    return vecs, var, var / total if total else var * math.nan


def svd_table(spark: SparkSession, m: Moments, cols: list[str], n_components: int | None = None) -> DataFrame:
    _, var, ratio = svd_spectrum(m, cols)
    k = n_components if n_components is not None else len(cols) - 1
    return variance_table(spark, list(var[:k]), list(ratio[:k]))


def svd_project(df: DataFrame, m: Moments, cols: list[str], k: int, keep: list[str] = ()) -> DataFrame:
    """Rows on the top-k right singular vectors, ``sv1`` to ``svk``."""
    vecs, _, _ = svd_spectrum(m, cols)
    return project(df, cols, np.zeros(len(cols)), vecs[:, :k], "sv", keep)


def svd_top_loading(spark: SparkSession, m: Moments, cols: list[str], k: int) -> DataFrame:
    """Feature with the largest absolute loading on each of the first k components."""
    vecs, _, _ = svd_spectrum(m, cols)
    rows = [
        (c + 1, cols[int(np.argmax(np.abs(vecs[:, c])))], float(np.round(np.max(np.abs(vecs[:, c])), 6)))
        for c in range(k)
    ]
    return spark.createDataFrame(rows, "component INT, feature STRING, abs_loading DOUBLE")


def condition_number(m: Moments, cols: list[str]) -> float:
    """σmax/σmin of the uncentred data matrix (√ of the Gram eigenvalue ratio)."""
    vals = np.linalg.eigvalsh(m.uncentered(cols))
    lo, hi = float(vals.min()), float(vals.max())
    if lo <= 0:
        return math.inf
    return math.sqrt(hi / lo)


# --------------------------------------------------------------------------- OLS

@dataclass
class OlsFit:
    terms: list[str]
    coef: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: float
    ssr: float
    r2: float
    r2_adj: float
    llf: float
    aic: float
    bic: float
    dof: float


def ols(m: Moments, terms: list[str], y: str) -> OlsFit:
    """OLS of ``y`` on ``terms`` from the moments; ``const`` means an intercept.

    With an intercept the slopes are solved on centred moments (stable) and R²
    is centred; without one R² is uncentred, as statsmodels reports it.
    """
    n = m.n
    k = len(terms)
    has_const = CONST in terms
    xtx = m.uncentered(terms)
    if y == CONST:
        xty = np.array([n if t == CONST else n * m.mean[m.index(t)] for t in terms])
        yty = n
        sst = 0.0
    else:
        yi = m.index(y)
        xty = np.array(
            [n * m.mean[yi] if t == CONST else m.csum[m.index(t), yi] + n * m.mean[m.index(t)] * m.mean[yi] for t in terms]
        )
        yty = m.csum[yi, yi] + n * m.mean[yi] ** 2
        sst = m.csum[yi, yi]
    slopes = [t for t in terms if t != CONST]
    if has_const and y != CONST:
        yi = m.index(y)
        if slopes:
            c_ss = m.centered(slopes)
            c_sy = np.array([m.csum[m.index(s), yi] for s in slopes])
            b_s = np.linalg.pinv(c_ss) @ c_sy
            ssr = float(m.csum[yi, yi] - c_sy @ b_s)
        else:
            b_s = np.array([])
            ssr = float(m.csum[yi, yi])
        intercept = m.mean[yi] - sum(m.mean[m.index(s)] * b for s, b in zip(slopes, b_s))
        lookup = dict(zip(slopes, b_s))
        coef = np.array([intercept if t == CONST else lookup[t] for t in terms])
    else:
        coef = np.linalg.pinv(xtx) @ xty
        ssr = float(yty - coef @ xty)
    ssr = max(ssr, 0.0)
    dof = n - np.linalg.matrix_rank(xtx)
    sigma2 = ssr / dof if dof > 0 else math.nan
    cov = sigma2 * np.linalg.pinv(xtx)
    se = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        tvals = coef / se
    pvals = np.array([t_two_sided_p(float(tv), dof) for tv in tvals])
    if has_const:
        r2 = 1.0 - ssr / sst if sst > 0 else math.nan
    else:
        r2 = 1.0 - ssr / yty if yty > 0 else math.nan
    k_const = 1 if has_const else 0
    r2_adj = 1.0 - (n - k_const) / dof * (1.0 - r2) if dof > 0 else math.nan
    llf = -n / 2.0 * (math.log(2.0 * math.pi * ssr / n) + 1.0) if ssr > 0 else math.inf
    rank = n - dof
    aic = -2.0 * llf + 2.0 * rank
    bic = -2.0 * llf + math.log(n) * rank
    return OlsFit(list(terms), coef, se, tvals, pvals, n, ssr, r2, r2_adj, llf, aic, bic, dof)


def backward_elimination(m: Moments, terms: list[str], y: str, p_max: float = 0.01, protect_const: bool = False):
    """Drop the term with the largest p-value while it is >= ``p_max``.

    Returns (final fit, trace rows measured before each drop, removed terms).
    Every step is a p×p solve on the same moments — no further Spark job.
    """
    terms = list(terms)
    trace, removed = [], []
    while terms:
        fit = ols(m, terms, y)
        cand = [(p, t) for p, t in zip(fit.p, terms) if not (protect_const and t == CONST)]
        cand = [(p if not math.isnan(p) else math.inf, t) for p, t in cand]
        if not cand:
            break
        worst_p, worst = max(cand, key=lambda pt: pt[0])
        if worst_p >= p_max:
            trace.append((worst, fit.aic, fit.bic, fit.r2_adj, float(worst_p), fit.r2))
            terms.remove(worst)
            removed.append(worst)
        else:
            break
    return ols(m, terms, y), trace, removed


def ols_coef_table(spark: SparkSession, fit: OlsFit, scale: int = 6) -> DataFrame:
    rows = [
        (t, float(c), float(s), float(tv), float(p))
        for t, c, s, tv, p in zip(fit.terms, fit.coef, fit.se, fit.t, fit.p)
    ]
    df = spark.createDataFrame(rows, "term STRING, coef DOUBLE, std_err DOUBLE, t DOUBLE, p_value DOUBLE")
    return df.select("term", *[round_even(c, scale).alias(c) for c in ["coef", "std_err", "t", "p_value"]])


def ols_conf_int(spark: SparkSession, fit: OlsFit, level: float = 0.95, scale: int = 3) -> DataFrame:
    q = t_quantile(1.0 - (1.0 - level) / 2.0, fit.dof)
    rows = [(t, float(c - q * s), float(c + q * s)) for t, c, s in zip(fit.terms, fit.coef, fit.se)]
    df = spark.createDataFrame(rows, "term STRING, lower DOUBLE, upper DOUBLE")
    return df.select("term", round_even("lower", scale).alias("lower"), round_even("upper", scale).alias("upper"))


def ols_predict(df: DataFrame, fit: OlsFit, name: str = "prediction") -> DataFrame:
    """ŷ as one JVM expression over the kept terms."""
    expr = F.lit(0.0)
    for t, c in zip(fit.terms, fit.coef):
        expr = expr + (F.lit(float(c)) if t == CONST else F.col(t) * F.lit(float(c)))
    return df.withColumn(name, expr)


# --------------------------------------------------------------------------- VIF

def vif(m: Moments, terms: list[str]) -> list[tuple[str, float]]:
    """Variance inflation factor of each term regressed on the others."""
    out = []
    for t in terms:
        others = [o for o in terms if o != t]
        fit = ols(m, others, t) if others else None
        if fit is None:
            out.append((t, 1.0))
            continue
        r2 = fit.r2
        out.append((t, math.inf if r2 >= 1.0 else 1.0 / (1.0 - r2)))
    return out


def vif_table(spark: SparkSession, m: Moments, terms: list[str], scale: int = 6) -> DataFrame:
    rows = [(t, float(v)) for t, v in vif(m, terms)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("feature", T.StringType()), T.StructField("vif", T.DoubleType())]))
    return df.select("feature", round_even("vif", scale).alias("vif"))
