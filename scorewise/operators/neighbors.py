"""Exact k-nearest-neighbour join (L2) without a cross join.

Plan (all steps are Spark jobs; only p-sized / cell-sized summaries reach the driver):

1. Pivots (``PIVOTS``; of many rows one for ``CELL_ROWS``) are the reference rows with the smallest id hash.
2. Every reference row is assigned to its nearest pivot (a *cell*); per cell the
   driver learns the row count and the nearest and farthest distance from the pivot.
3. Every query row goes to its nearest cells, as few as hold ``k`` rows (nearly
   always one): the k-th distance found there is an upper bound ``U``.
4. It goes on to the other cells that can hold a row at most ``U`` away: by the
   triangle inequality, from the cell's nearest and farthest row, and by the plane
   between the cell's pivot and the query's.  This is exact: no true neighbour can
   live in a pruned cell.  A query row is sent once for each of these cells.
5. Hot cells are split into blocks of at most ``block_rows`` rows (by default as many
   as have ``BLOCK`` numbers) on both sides (queries and references), so no task ever holds more than one block pair —
   a cell holding a third of all rows is spread over many tasks.
6. Each block pair is scored in numpy and only the partial top-k per query
   leaves the task; a final per-query top-k (``row_number`` with Spark's
   window group limit) merges the partials.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewise.session import cut_lineage


def _as_matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=float) for v in series.to_numpy()])


def _pivots(ref: DataFrame, n_pivots: int, seed: int) -> np.ndarray:
    rows = (
        ref.select("rv", F.xxhash64(F.lit(seed), F.col("rid")).alias("_h"), "rid")
        .orderBy("_h", "rid")
        .limit(n_pivots)
        .collect()
    )
    return np.stack([np.asarray(r["rv"], dtype=float) for r in rows])


def _squares_to(x: np.ndarray, piv: np.ndarray) -> np.ndarray:
    return np.clip((x * x).sum(1)[:, None] + (piv * piv).sum(1)[None, :] - 2.0 * x @ piv.T, 0.0, None)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


#: Reference rows of a cell: at least, with fewer than ``PIVOTS`` cells, and at most, with fewer than ``MOST_PIVOTS``.
FEW_ROWS, CELL_ROWS, PIVOTS, MOST_PIVOTS = 4096, 131_072, 32, 4096
#: Numbers of the reference rows, or of the query rows, that a task holds.
BLOCK = 4_000_000
#: Bound on the rounding error of a squared distance, relative to the squared norms.
ROUNDING = 1e-13


class Cells:
    """The cells of one group: which, their rows, nearest and farthest row; and which of them a query has to visit."""

    def __init__(self, rows: list, piv: np.ndarray, need: int) -> None:
        self.cells = np.array([s["cell"] for s in rows], dtype=int)
        self.n = np.array([s["n"] for s in rows], dtype=float)
        self.piv, self.need = piv, need
        far = np.array([s["radius"] for s in rows], dtype=float)
        self.norm = float((np.sqrt((piv * piv).sum(1).max()) + far.max()) ** 2)
        off = 4 * ROUNDING * (1.0 + self.norm)
        self.near = np.sqrt(np.clip(np.array([s["inner"] for s in rows], dtype=float) ** 2 - off, 0.0, None))
        self.far = np.sqrt(far**2 + off)

    def home(self, d2: np.ndarray) -> np.ndarray:
        """The nearest cells that together hold as many rows as are asked for, or all."""
        order = np.argsort(d2[:, self.cells], axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < self.need, axis=1)
        return out

    def reach(self, x: np.ndarray, d2: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The cells that may hold a row at most ``bound`` away."""
        off = 4 * ROUNDING * (1.0 + self.norm + (x * x).sum(1))[:, None]
        here = d2[:, self.cells]
        lower = np.maximum(np.sqrt(np.clip(here - off, 0.0, None)) - self.far, self.near - np.sqrt(here + off))
        own, at = np.unique(d2.argmin(1), return_inverse=True)
        apart = np.sqrt(_squares_to(self.piv[own], self.piv[self.cells]) + 4 * ROUNDING * (1.0 + self.norm))[at]
        lower = np.maximum(lower, (here - d2.min(1)[:, None] - 2 * off) / (2 * apart))
        return lower <= bound[:, None] * (1 + 1e-9) + 1e-9


#: Pairs that a task scores exactly at once.
PAIRS = 200_000
#: Pairs that a task screens at once, and numbers of the query copies that it sends at once.
SCREENED, SENT = 1_000_000, 2_000_000
#: Reference rows that are screened together once bounds are known.
TILE = 8192


def block_top(
    qids: np.ndarray, xq: np.ndarray, rids: np.ndarray, xr: np.ndarray, k: int, exclude_self: bool = False,
    bound: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, distance) of each query's ``k`` nearest rows of one block pair, in bounded memory.

    With finite ``bound``s only rows that near, up to ``k`` of every ``TILE`` rows: one comparison a pair."""
    known = bound is not None and bool(np.isfinite(bound).all())
    if known and len(xr) > TILE:
        parts = [block_top(qids, xq, rids[at:at + TILE], xr[at:at + TILE], k, exclude_self, bound) for at in range(0, len(xr), TILE)]
        return tuple(np.concatenate(c) for c in zip(*parts))
    mu = xr.mean(axis=0)  # centring shrinks the cancellation of the |a|²+|b|²-2ab screen
    rc_ = xr - mu
    rn = (rc_ * rc_).sum(1)
    kk = min(k, xr.shape[0])
    found = []
    wide = max(1, SCREENED // len(xr))
    step = max(1, PAIRS // len(xr))  # ties can make every pair a candidate
    for top in range(0, len(xq), wide):  # some queries at a time: the screen never holds a whole block pair
        qc_ = xq[top:top + wide] - mu
        qn = (qc_ * qc_).sum(1)
        d2 = qc_ @ rc_.T
        d2 *= -2.0
        d2 += qn[:, None] + rn[None, :]
        if exclude_self:
            d2[qids[top:top + wide, None] == rids[None, :]] = np.inf
        # Screen: every candidate within rounding distance of the k-th screened
        # distance is re-scored exactly, so ties and rounding never drop a true neighbour.
        kth = bound[top:top + wide] ** 2 if known else np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        # bound on the screen's rounding error: relative to d2 and to the squared norms
        thr = kth + 1e-9 * (1.0 + np.abs(kth)) + 1e-12 * (qn + rn.max())
        near = (d2 <= thr[:, None]) & np.isfinite(d2)
        for lo in range(0, len(near), step):
            rows_i, cols_j = np.nonzero(near[lo:lo + step])
            rows_i += top + lo
            diff = xr[cols_j] - xq[rows_i]
            exact = np.sqrt((diff * diff).sum(-1))
            cand = rids[cols_j]
            order = np.lexsort((cand, exact, rows_i))
            rows_o, exact_o, cand_o = rows_i[order], exact[order], cand[order]
            keep = np.arange(len(rows_o)) - np.searchsorted(rows_o, rows_o, side="left") < k
            found.append((qids[rows_o[keep]].astype("int64"), cand_o[keep].astype("int64"), exact_o[keep]))
    qid, nid, distance = (np.concatenate(c) for c in zip(*found))
    return qid, nid, distance


def knn_join(
    queries: DataFrame,
    reference: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "v",
    group_col: str | None = None,
    exclude_self: bool = False,
    n_pivots: int | None = None,
    block_rows: int | None = None,
    seed: int = 17,
    materialize: bool = True,
) -> DataFrame:
    """For every query row its ``k`` nearest reference rows.

    Returns ``(qid, rank, nid, distance)``; rank is 1-based, ties broken by the
    neighbour id.  ``group_col`` restricts neighbours to the query's own group
    (few distinct values expected, e.g. a class label); ``exclude_self`` drops
    the pair of a row with itself (same id).
    """
    grp = (F.col(group_col) if group_col else F.lit(0)).cast("long")
    vec = F.col(vec_col).cast("array<double>")
    q = queries.select(F.col(id_col).cast("long").alias("qid"), vec.alias("qv"), grp.alias("grp"), F.lit(math.inf).alias("u"))
    r = reference.select(F.col(id_col).cast("long").alias("rid"), vec.alias("rv"), grp.alias("grp"))
    spark = queries.sparkSession

    n_ref = 0 if n_pivots else r.count()
    piv = _pivots(r, n_pivots or max(1, min(PIVOTS, n_ref // FEW_ROWS), min(MOST_PIVOTS, n_ref // CELL_ROWS)), seed)
    block_rows = block_rows or max(FEW_ROWS, BLOCK // max(1, piv.shape[1]))
    step = max(1, SCREENED // len(piv))

    def assign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                d2 = _squares_to(_vectors(batch, "rv"), piv)
                cell = d2.argmin(1)
                dcell = np.sqrt(d2[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dcell)], [*batch.schema.names, "cell", "dcell"])

    rc = r.mapInArrow(assign, "rid long, rv array<double>, grp long, cell int, dcell double")
    if materialize:
        rc = cut_lineage(rc)  # read by the cell statistics and by the block joins
    stats = rc.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("dcell").alias("inner"), F.max("dcell").alias("radius")).collect()
    sizes = {(s["grp"], s["cell"]): int(s["n"]) for s in stats}
    by_group = {
        g: Cells([s for s in stats if s["grp"] == g], piv, k + (1 if exclude_self else 0)) for g in {s["grp"] for s in stats}
    }

    def visits(batch, home):
        """(row, cell) of the cells that query rows go to: those at home, or the others within their bounds ``u``."""
        x = _vectors(batch, "qv")
        d2 = _squares_to(x, piv)
        groups = np.array(batch.column("grp").to_pylist(), dtype=object)
        bound = batch.column("u").to_numpy()
        found = []
        for g in {*groups.tolist()} & {*by_group}:
            rows, of = np.flatnonzero(groups == g), by_group[g]
            keep = of.home(d2[rows])
            if not home:
                keep = ~keep & of.reach(x[rows], d2[rows], bound[rows])
            i, j = np.nonzero(keep)
            found.append((rows[i], of.cells[j]))
        return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int)] * 2

    def pieces(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield whole.slice(at, step)

    def tally(batches, home):
        sums: dict[tuple, int] = {}
        for batch in pieces(batches):
            rows, cells = visits(batch, home)
            groups = batch.column("grp").to_pylist()
            for i, cell in zip(rows.tolist(), cells.tolist()):
                sums[groups[i], cell] = sums.get((groups[i], cell), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in sums], pa.int64()), pa.array([c for _, c in sums], pa.int32()), pa.array([*sums.values()], pa.int64())], ["grp", "cell", "n"]
        )

    def copies(batches, home):
        for batch in pieces(batches):
            rows, cells = visits(batch, home)
            wide = max(1, SENT // max(1, piv.shape[1]))  # few copies at a time
            for at in range(0, len(rows), wide):
                part = batch.take(pa.array(rows[at : at + wide]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[at : at + wide].astype(np.int32))], [*part.schema.names, "cell"])

    def score(key, qpdf, rpdf):
        if qpdf.empty or rpdf.empty:
            return pd.DataFrame({"qid": [], "nid": [], "distance": []})
        cols = block_top(
            qpdf["qid"].to_numpy(), _as_matrix(qpdf["qv"]), rpdf["rid"].to_numpy(), _as_matrix(rpdf["rv"]), k, exclude_self, qpdf["u"].to_numpy()
        )
        return pd.DataFrame(dict(zip(("qid", "nid", "distance"), cols)))

    def nearest(rows, home):
        """Partial top-k of query rows in the cells that they visit, and nothing if they visit none."""
        counts = rows.mapInArrow(functools.partial(tally, home=home), "grp long, cell int, n long").groupBy("grp", "cell").agg(F.sum("n").alias("n")).collect()
        blocks = [
            (s["grp"], s["cell"], math.ceil(s["n"] / block_rows), math.ceil(sizes[s["grp"], s["cell"]] / block_rows)) for s in counts
        ]
        # One row per (group, cell): bounded by groups × pivots.
        bdf = F.broadcast(spark.createDataFrame(blocks, "grp long, cell int, nqb int, nrb int"))
        same = ["grp", "cell"]
        qside = (
            rows.mapInArrow(functools.partial(copies, home=home), "qid long, qv array<double>, grp long, u double, cell int").join(bdf, same)
            .withColumn("qb", F.pmod(F.xxhash64(F.col("qid")), F.col("nqb")).cast("int"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nrb") - 1)))
            .select("grp", "cell", "qb", "rb", "qid", "qv", "u")
        )
        rside = (
            rc.join(bdf, same)
            .withColumn("rb", F.pmod(F.xxhash64(F.col("rid")), F.col("nrb")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
            .select("grp", "cell", "qb", "rb", "rid", "rv")
        )
        found = qside.groupBy("grp", "cell", "qb", "rb").cogroup(rside.groupBy("grp", "cell", "qb", "rb"))
        return found.applyInPandas(score, "qid long, nid long, distance double") if blocks else None

    def top(found):
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "nid"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "nid", "distance")

    found = nearest(q, True)
    if found is None:
        return spark.createDataFrame([], "qid long, rank int, nid long, distance double")
    if all(len(c.cells) == 1 for c in by_group.values()):
        return top(found)
    first = top(found)
    if materialize:
        first = cut_lineage(first)
    bounds = first.filter(F.col("rank") == k).select(F.col("qid").alias("_q"), F.col("distance").alias("_u"))
    rest = q.drop("u").join(bounds, F.col("qid") == F.col("_q"), "left").select("qid", "qv", "grp", F.coalesce("_u", F.lit(math.inf)).alias("u"))
    if materialize:
        rest = cut_lineage(rest)
    more = nearest(rest, False)
    return first if more is None else top(first.drop("rank").unionByName(more))


def vote(knn: DataFrame, labels: DataFrame, ks: list[int], id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Majority vote among the first k neighbours for every k in ``ks``; ties -> smaller label.

    One join at max(ks), then each k reuses the ranks (no refit per k).
    Returns (qid, k, prediction).
    """
    lab = labels.select(F.col(id_col).alias("nid"), F.col(label_col).alias("_nl"))
    j = knn.join(lab, "nid").withColumn("k", F.explode(F.array(*[F.lit(int(v)) for v in ks])))
    j = j.filter(F.col("rank") <= F.col("k"))
    counts = j.groupBy("qid", "k", "_nl").agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy("qid", "k").agg(
        F.max_by("_nl", F.struct(F.col("_c"), -F.col("_nl"))).alias("prediction")
    )
    return best
