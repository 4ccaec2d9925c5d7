"""Regression steps as sweeps of one moment matrix.

A sweep moves a variable between "response" and "regressor" and back; each is
one O(p^2) update of the matrix that ``linalg.moments`` made in a single scan.
Once all regressors are swept, the matrix holds the inverse of X'X, the
coefficients and the residual sum of squares side by side.  Dropping a
regressor is one more sweep, and all variance inflation factors are read off
the diagonal.

Columns are scaled to unit length and taken in order of what is left of them
(the largest first).  A column of which less than ``TOLERANCE`` is left depends
on the ones already taken: it is never swept, and is reported.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even
from scorewise.functions.stats import t_two_sided_p
from scorewise.operators.linalg import CONST, Moments, OlsFit

TOLERANCE = 1e-10


def swept(a: np.ndarray, k: int) -> np.ndarray:
    """``a`` swept at ``k``; a second sweep at ``k`` takes it back."""
    d = a[k, k]
    row, col = a[k] / d, a[:, k].copy()
    out = a - np.outer(col, row)
    out[k], out[:, k] = row, -col / d
    out[k, k] = 1.0 / d
    return out


class Regression:
    """Least squares of ``y`` on ``terms`` with sweeps in and out; ``const`` among the terms is the intercept.

    The intercept is taken first, from the means and centred products, so that
    large means cost no digits; ``y`` may be left out (variance inflation only).
    """

    def __init__(self, m: Moments, terms: list[str], y: str | None = None) -> None:
        self.m, self.terms, self.y = m, list(terms), y
        names = [t for t in terms if t != CONST]
        self.names = names + ([y] if y else [])
        idx = [m.index(c) for c in self.names]
        means = m.mean[idx]
        self.active: set[str] = set()
        self.place = {c: i for i, c in enumerate(self.names)}
        products = m.csum[np.ix_(idx, idx)]
        if CONST in self.terms:
            self.total = {c: products[i, i] for c, i in self.place.items()}
            a = np.zeros((len(idx) + 1,) * 2)
            a[:-1, :-1], a[-1, :-1], a[:-1, -1] = products, means, -means
            a[-1, -1] = 1.0 / m.n
            self.place[CONST] = len(idx)
            self.active.add(CONST)
        else:
            a = products + m.n * np.outer(means, means)
            self.total = {c: a[i, i] for c, i in self.place.items()}
        size = np.array([math.sqrt(v) if v > 0 else 1.0 for v in np.diag(a)])
        if CONST in self.terms:
            size[-1] = math.sqrt(m.n)
            a[-1, -1] = 1.0
            a[-1, :-1] *= math.sqrt(m.n) / size[:-1]
            a[:-1, -1] = -a[-1, :-1]
            a[:-1, :-1] /= np.outer(size[:-1], size[:-1])
        else:
            a = a / np.outer(size, size)
        self.a, self.size = a, size
        left = [t for t in names if self.total[t] > 0]
        while left:
            best = max(left, key=lambda t: self.a[self.place[t], self.place[t]])
            if self.a[self.place[best], self.place[best]] <= TOLERANCE:
                break
            self.flip(best)
            left.remove(best)
        #: Terms that the others determine (a constant column beside the intercept too).
        self.dependent = [t for t in self.terms if t not in self.active]

    def flip(self, term: str) -> None:
        """Take ``term`` in, or out again."""
        self.a = swept(self.a, self.place[term])
        self.active ^= {term}

    def fit(self) -> OlsFit:
        """The regression of ``y`` on the active terms, in their given order."""
        m, yi = self.m, self.place[self.y]
        terms = [t for t in self.terms if t in self.active]
        at = [self.place[t] for t in terms]
        has_const = CONST in self.active
        n, dof = m.n, m.n - len(terms)
        mean_y = float(m.mean[m.index(self.y)])
        sst = float(m.csum[m.index(self.y), m.index(self.y)])
        yty = sst + n * mean_y**2
        ssr = max(float(self.a[yi, yi]) * self.size[yi] ** 2, 0.0)
        coef = self.a[at, yi] * self.size[yi] / self.size[at]
        sigma2 = ssr / dof if dof > 0 else math.nan
        se = np.sqrt(np.clip(sigma2 * np.diag(self.a)[at], 0.0, None)) / self.size[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = coef / se
        p = np.array([t_two_sided_p(float(v), dof) for v in t])
        base = sst if has_const else yty
        r2 = 1.0 - ssr / base if base > 0 else math.nan
        r2_adj = 1.0 - (n - int(has_const)) / dof * (1.0 - r2) if dof > 0 else math.nan
        llf = -n / 2.0 * (math.log(2.0 * math.pi * ssr / n) + 1.0) if ssr > 0 else math.inf
        return OlsFit(
            terms, coef, se, t, p, n, ssr, r2, r2_adj, llf, -2.0 * llf + 2.0 * len(terms), -2.0 * llf + math.log(n) * len(terms) if n else math.nan, dof
        )

    def vif(self) -> list[tuple[str, float]]:
        """Variance inflation of each term given the others; infinite for one that the others determine.

        A dependent column makes every column infinite that it depends on.
        """
        tied = set(self.dependent)
        for d in self.dependent:
            if self.total.get(d, 0.0) > 0:
                tied |= {t for t in self.active if abs(self.a[self.place[t], self.place[d]]) > math.sqrt(TOLERANCE)}
            elif CONST in self.active:  # a constant column beside the intercept
                tied.add(CONST)
        return [(t, math.inf if t in tied else float(self.a[self.place[t], self.place[t]])) for t in self.terms]


def backward_elimination(m: Moments, terms: list[str], y: str, p_max: float = 0.01):
    """Drop the term with the largest p-value while that is >= ``p_max``, one sweep a step.

    Returns (final fit, trace rows measured before each drop, dependent terms).
    Dependent terms were never taken in and aren't in the trace.
    """
    reg = Regression(m, terms, y)
    trace = []
    while reg.active:
        fit = reg.fit()
        p = [math.inf if math.isnan(v) else float(v) for v in fit.p]
        worst = int(np.argmax(p))
        if p[worst] < p_max:
            break
        trace.append((fit.terms[worst], fit.aic, fit.bic, fit.r2_adj, p[worst], fit.r2))
        reg.flip(fit.terms[worst])
    return reg.fit(), trace, reg.dependent


def vif_table(spark: SparkSession, m: Moments, terms: list[str], scale: int = 6) -> DataFrame:
    """(feature, vif) of all terms from one swept matrix."""
    df = spark.createDataFrame([(t, float(v)) for t, v in Regression(m, terms).vif()], "feature STRING, vif DOUBLE")
    v = F.col("vif")
    return df.select("feature", F.when(v == math.inf, v).otherwise(round_even("vif", scale)).alias("vif"))
