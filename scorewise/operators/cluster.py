"""Clustering: k-means (Spark ML), assignment to fixed centroids, within-cluster
sum of squares and the Euclidean silhouette.

Spark's ``ClusteringEvaluator`` only offers squared-Euclidean and cosine
silhouettes; the Euclidean one needs the mean distance from every row to
every cluster.  It is computed in row blocks: each pair of blocks is met once,
as matrix products over small tiles, and emits only each row's distance sums
by cluster, which a group-by adds up — pairs are never materialised as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def kmeans(df: DataFrame, k: int, vec_col: str = "v", seed: int = 1, max_iter: int = 20):
    """Fit Spark ML k-means (k-means|| init) on an array<double> column."""
    data = df.withColumn("_features", array_to_vector(F.col(vec_col)))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(data)


def kmeans_predict(model, df: DataFrame, vec_col: str = "v") -> DataFrame:
    out = model.transform(df.withColumn("_features", array_to_vector(F.col(vec_col))))
    return out.drop("_features")


def wss_on_dims(assigned: DataFrame, dims: list[int], vec_col: str = "v", cluster_col: str = "cluster") -> float:
    """Within-cluster sum of squares of an assignment, restricted to vector positions ``dims``."""
    ex = assigned.select(cluster_col, F.posexplode(vec_col).alias("pos", "x")).filter(F.col("pos").isin(*dims))
    per = ex.groupBy(cluster_col, "pos").agg((F.var_pop("x") * F.count("x")).alias("s"))
    return float(per.agg(F.sum("s")).first()[0] or 0.0)


def elbow(df: DataFrame, ks: list[int], vec_col: str = "v", seed: int = 1,
          dims: list[int] | None = None) -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares) for every k — one fit per k on cached input.

    k = 1 has the closed form Σ n·var_pop (Spark's k-means needs k >= 2).
    ``dims`` restricts the sum to some vector positions (the reference sums only
    the first two columns); by default all dimensions count.
    """
    data = df.select(F.col(vec_col).alias("_v"), array_to_vector(F.col(vec_col)).alias("_features")).persist()
    try:
        out = []
        for k in ks:
            if k == 1 and dims is None:
                out.append((1, float(wss_single_cluster(df, vec_col).first()["wss"])))
                continue
            if k == 1:
                out.append((1, wss_on_dims(data.withColumn("cluster", F.lit(0)), dims, "_v")))
                continue
            m = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(data)
            if dims is None:
                out.append((k, float(m.summary.trainingCost)))
            else:
                out.append((k, wss_on_dims(m.transform(data), dims, "_v")))
        return out
    finally:
        data.unpersist()


def _sq_dist_expr(vec_col: str, centre: list[float]):
    c = F.array(*[F.lit(float(x)) for x in centre])
    diffs = F.zip_with(F.col(vec_col), c, lambda a, b: (a - b) * (a - b))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def assign(df: DataFrame, centroids: list[tuple[int, list[float]]], vec_col: str = "v") -> DataFrame:
    """Nearest fixed centroid per row (ties -> smaller cluster id); JVM expressions only.

    ``centroids`` is a short driver-side list (k entries)."""
    cands = F.array(
        *[F.struct(F.sqrt(_sq_dist_expr(vec_col, c)).alias("distance"), F.lit(int(cid)).alias("cluster")) for cid, c in centroids]
    )
    best = F.array_min(cands)
    return df.withColumn("_best", best).select(
        *df.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance")
    )


def centroid_update(assigned: DataFrame, vec_col: str = "v") -> DataFrame:
    """One Lloyd step: mean vector per cluster, as (cluster, n, centroid)."""
    ex = assigned.select("cluster", F.posexplode(vec_col).alias("pos", "x"))
    per_dim = ex.groupBy("cluster", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return per_dim.groupBy("cluster").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"),
    )


def wss_single_cluster(df: DataFrame, vec_col: str = "v") -> DataFrame:
    """Within-cluster sum of squares for k = 1: Σ over dimensions of n · var_pop."""
    ex = df.select(F.posexplode(vec_col).alias("pos", "x"))
    per_dim = ex.groupBy("pos").agg((F.var_pop("x") * F.count("x")).alias("s"))
    return per_dim.agg(F.sum("s").alias("wss"))


def silhouette_squared(df: DataFrame, label_cols: list[str], vec_col: str = "v") -> DataFrame:
    """Mean silhouette by squared Euclidean distance for each labelling, as (labeling, silhouette).

    The squared distances from a row to all rows of a cluster add up to
    ``n |x|² + Σ|y|² - 2 x·Σy``: every row meets the clusters' counts, vector
    sums and squared norms (labelings × clusters × dimensions numbers), never
    other rows.  Rows of a cluster of one score 0.
    """
    labels = F.array(*[F.col(c).cast("long") for c in label_cols])
    rows = df.select(F.col(vec_col).alias("v"), F.posexplode(labels).alias("s", "c"))
    dims = rows.select("s", "c", F.posexplode("v").alias("pos", "x")).groupBy("s", "c", "pos").agg(
        F.count("x").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    stats = dims.groupBy("s", "c").agg(
        F.max("n").alias("n"), F.sum("q").alias("q"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "sx"))), lambda p: p["sx"]).alias("sums"),
    )
    clusters = stats.groupBy("s").agg(F.collect_list(F.struct("c", "n", "q", "sums")).alias("cl"))
    met = rows.join(F.broadcast(clusters), "s")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    norm = dot(F.col("v"), F.col("v"))
    total = F.transform(
        "cl", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), F.greatest(k["n"] * F.col("_norm") + k["q"] - 2 * dot(F.col("v"), k["sums"]), F.lit(0.0)).alias("d"))
    )
    met = met.withColumn("_norm", norm).withColumn("_t", total)
    own = F.filter("_t", lambda t: t["c"] == F.col("c"))[0]
    others = F.filter("_t", lambda t: t["c"] != F.col("c"))
    a = F.try_divide(own["d"], (own["n"] - 1).cast("double"))
    b = F.array_min(F.transform(others, lambda t: t["d"] / t["n"]))
    value = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in label_cols])
    return met.groupBy("s").agg(F.avg(value).alias("silhouette")).select(names[F.col("s")].alias("labeling"), "silhouette")


#: Rows that are met side by side, and sums that a task holds for each of its two blocks.
TILE_LEFT, TILE_RIGHT, HELD = 256, 2048, 4_000_000
#: Blocks at least, so that medium inputs use all cores.
MIN_BLOCKS = 16


def distances(xl: np.ndarray, xr: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by |a|² + |b|² - 2ab; pairs so close that this loses digits are met directly."""
    ln, rn = (xl * xl).sum(1), (xr * xr).sum(1)
    d2 = xl @ xr.T
    d2 *= -2.0
    norms = ln[:, None] + rn[None, :]
    d2 += norms
    norms *= 1e-6
    apart = d2 > norms
    i, j = np.nonzero(~apart) if not apart.all() else ((), ())
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        diff = xl[a] - xr[b]
        d2[a, b] = (diff * diff).sum(1)
    return np.sqrt(d2, out=d2)


def block_sums(xl: np.ndarray, il: np.ndarray, xr: np.ndarray | None, ir: np.ndarray | None) -> list[np.ndarray]:
    """Summed distances from each left row to the right rows of each cluster, and from each right row to the left ones.

    ``il`` and ``ir`` are the rows' 0/1 memberships, one column per (labelling, cluster);
    without a right block the left one meets itself."""
    mu = xl.mean(axis=0)  # centring keeps the norms small
    xl = xl - mu
    xr_, ir_ = (xl, il) if xr is None else (xr - mu, ir)
    left, right = np.zeros((len(xl), il.shape[1])), None if xr is None else np.zeros((len(xr_), il.shape[1]))
    for r in range(0, len(xr_), TILE_RIGHT):
        xt, it = xr_[r : r + TILE_RIGHT], ir_[r : r + TILE_RIGHT]
        for lo in range(0, len(xl), TILE_LEFT):
            d = distances(xl[lo : lo + TILE_LEFT], xt)
            left[lo : lo + TILE_LEFT] += d @ it
            if right is not None:
                right[r : r + TILE_RIGHT] += d.T @ il[lo : lo + TILE_LEFT]
    return [left] if right is None else [left, right]


def silhouette(
    df: DataFrame, label_cols: list[str], id_col: str = "id", vec_col: str = "v", block_rows: int = 32_768
) -> DataFrame:
    """Mean Euclidean silhouette for each labelling column in ``label_cols``.

    Returns (labeling, silhouette).  Singleton clusters score 0 (as sklearn).
    All pairs are met, each once: a task gets two blocks and returns, for each
    row, its distances to the other block summed by cluster.
    """
    base = df.select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("v"),
        F.array(*[F.col(c).cast("long") for c in label_cols]).alias("labs"),
    )
    sizes = base.select(F.posexplode("labs").alias("s", "c")).groupBy("s", "c").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per cluster
    cells = sorted((r["s"], r["c"], r["n"]) for r in sizes if r["c"] is not None)
    if not cells:
        return df.sparkSession.createDataFrame([], "labeling string, silhouette double")
    code = {(s, c): i for i, (s, c, _) in enumerate(cells)}
    n, width = sum(r["n"] for r in sizes if r["s"] == 0), len(cells)
    size = max(1, min(block_rows, HELD // width, max(2048, math.ceil(n / MIN_BLOCKS))))
    nb = math.ceil(n / size)
    base = base.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
    pairs = nb * (nb + 1) // 2
    other = F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("other")
    met = base.select("*", other).select("id", "v", "labs", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    met = met.withColumn("task", (F.col("hi") * (F.col("hi") + 1) / 2).cast("int") + F.col("lo"))
    dealt = met.repartitionById(min(pairs, 4096), F.pmod("task", F.lit(min(pairs, 4096))).cast("int")).sortWithinPartitions("task", "blk")

    def block(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        ids, v, labs = (t.column(c).combine_chunks() for c in ("id", "v", "labs"))
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        of = labs.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        member = np.zeros((len(ids), width))
        for (s, c), i in code.items():
            member[of[:, s] == c, i] = 1.0
        return ids, x, member

    def meet(parts: dict[int, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        blocks = [block(p) for p in parts.values()]
        done = block_sums(*blocks[0][1:], *(blocks[1][1:] if len(blocks) == 2 else (None, None)))
        step = max(1, 500_000 // width)
        for (ids, *_), sums in zip(blocks, done):
            for at in range(0, len(ids), step):
                part = sums[at : at + step]
                offsets = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids[at : at + step], pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))], ["id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, alone = None, {}, True  # a task of two blocks of which one has no rows meets no pairs
        for batch in batches:
            task, blk = batch.column("task").to_numpy(), batch.column("blk").to_numpy()
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            edges = (np.flatnonzero((task[1:] != task[:-1]) | (blk[1:] != blk[:-1])) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(task)]):
                if b == a:
                    continue
                if task[a] != now:
                    if parts and (alone or len(parts) == 2):
                        yield from meet(parts)
                    now, parts, alone = task[a], {}, lo[a] == hi[a]
                parts.setdefault(int(blk[a]), []).append(batch.slice(a, b - a))
        if parts and (alone or len(parts) == 2):
            yield from meet(parts)

    partial = dealt.mapInArrow(run, f"id {dict(base.dtypes)['id']}, d array<double>")
    sums = partial.groupBy("id").agg(*[F.sum(F.col("d")[i]).alias(f"_{i}") for i in range(width)])
    # an id that comes more than once has the distances of all its rows
    own = base.select("id", "labs", F.count(F.lit(1)).over(Window.partitionBy("id")).alias("m"))
    scores = []
    for s in range(len(label_cols)):
        mine = [(c, k, F.col(f"_{code[(s, c)]}")) for t, c, k in cells if t == s]
        label = F.col("labs")[s]
        a_sum = F.coalesce(*[F.when(label == c, d) for c, _, d in mine])
        a_cnt = F.coalesce(*[F.when(label == c, k * F.col("m")) for c, k, _ in mine])
        b = F.array_min(F.array(*[F.when(label != c, d / (k * F.col("m"))) for c, k, d in mine]))
        scores.append(F.struct(F.lit(s).alias("s"), a_sum.alias("a_sum"), a_cnt.alias("a_cnt"), b.alias("b")))
    rows = sums.join(own, "id").select("id", F.inline(F.array(*scores)))
    per_row = rows.groupBy("id", "s").agg(F.max("a_sum").alias("a_sum"), F.max("a_cnt").alias("a_cnt"), F.min("b").alias("b"))
    a = F.try_divide(F.col("a_sum"), (F.col("a_cnt") - 1).cast("double"))
    sil = F.when((F.col("a_cnt") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0))
    )
    names = F.array(*[F.lit(c) for c in label_cols])
    return per_row.groupBy("s").agg(F.avg(sil).alias("silhouette")).select(
        names[F.col("s")].alias("labeling"), "silhouette"
    )
