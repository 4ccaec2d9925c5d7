"""Registered model queries (rows-only checks): trees, linear models, kernels,
forests, ensembles, MLP, feature importances and cross-validation.

All of them share one model table: prepared applicants -> 27 features -> z-scores
(2 dp) -> deterministic 80/20 split by ID hash -> SMOTE on the training part
only -> reliable checkpoint (fits read the training rows many times).  Each
query makes the table itself: nothing is kept from one query to the next.
Folds are drawn first and each training part is balanced on its own, so no
synthetic row meets its parents across a fold.  The grids and ensembles
are those of the reference, over the axes that Spark has (trees: all of them).
"""

from __future__ import annotations

from itertools import product
from math import ceil, comb, sqrt
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from scorewise.functions.scalar import round_even, split_bucket
from scorewise.operators import bayes, classify, ensemble, forest, level_trees, resample
from scorewise.operators.encode import indicators, standardize
from scorewise.plans.analytics import STD_COLS
from scorewise.plans.registry import query
from scorewise.plans.relational import FEATURES, prepared
from scorewise.session import cut_lineage

SEED = 5805
CV_FOLDS = 5
FOREST_FOLDS = 3
CHECK_FOLDS = 2
# Deep trees: cache node ids (checkpointed to spark.checkpoint.dir every 10
# iterations) instead of re-walking every tree for every row at each level.
TREE_OPTS = {"cacheNodeIds": True, "maxMemoryInMB": 512}


def side_by_side(work, items) -> list:
    """``work`` of every item, in order; the jobs of four run at a time, so a fold's small steps leave no cores idle."""
    with ThreadPool(4) as pool:
        return pool.map(work, items, chunksize=1)


class ModelData:
    """Balanced training rows, test rows, and folds that are drawn before balancing."""

    def __init__(self, plain, train, test, feats):
        self.plain, self.train, self.test, self.feats = plain, train, test, feats
        self.n_train = train.count()
        self._splits = {}

    def splits(self, folds: int = CV_FOLDS):
        """(balanced training rows, held-out rows as they are) of each fold."""
        if folds not in self._splits:
            drawn = cut_lineage(resample.stratified_folds(self.plain, "label", "id", folds, seed=SEED))

            def split(f):
                return (
                    _balanced(drawn.filter(F.col("fold") != f).drop("fold")),
                    classify.vectors(drawn.filter(F.col("fold") == f).select(F.col("id").alias("key"), "id", "label", "v")),
                )

            self._splits[folds] = side_by_side(split, range(folds))
        return self._splits[folds]


def _balanced(rows):
    bal = resample.smote(rows, "label", "id", "v", k=5, seed=SEED)
    bal = bal.withColumn("key", F.xxhash64("id", F.coalesce(F.col("copy"), F.lit(-1))))
    known = F.transform("v", lambda x: F.coalesce(x, F.raise_error(F.lit("a feature is null")).cast("double")))
    return classify.vectors(cut_lineage(bal.select("key", "id", "label", known.alias("v"))))  # features hold the same numbers: not written


def model_data(spark, sf) -> ModelData:
    """Feature table of the model queries, materialised once per call (``sf`` may be one that is made already)."""
    if isinstance(sf, ModelData):
        return sf
    feats = list(FEATURES)
    rows = prepared(spark, sf).filter(F.col("response").isNotNull())
    z = standardize(rows, [c for c in STD_COLS if c in feats], 2)
    rows = z.select(
        F.col("ID").alias("id"), F.col("response").alias("label"),
        F.array(*[c.cast("double") for c in indicators(z, feats)]).alias("v"),
    )
    rows = cut_lineage(rows)  # the prep / encode / scale plan runs once
    b = split_bucket("id", SEED)
    train, test = rows.filter(b >= 20), rows.filter(b < 20)
    return ModelData(train, _balanced(train), cut_lineage(classify.vectors(test)), feats)


def _reg(c: float, n: int) -> float:
    """sklearn's C (penalty on the summed loss) as Spark's regParam (on the mean loss)."""
    return 1.0 / (c * n)


# --------------------------------------------------------------------------- trees

@query("dt_basic")
def dt_basic(spark, sf):
    d = model_data(spark, sf)
    est = DecisionTreeClassifier(impurity="gini", maxDepth=30, maxBins=64, seed=SEED, **TREE_OPTS)
    return classify.fit_score(est, d.train, d.test, "decision_tree")[1]


def _dt_points():
    est = DecisionTreeClassifier(maxBins=64, seed=SEED, **TREE_OPTS)
    return est, ParamGridBuilder().addGrid(est.maxDepth, [2, 8, 10]).addGrid(est.impurity, ["gini", "entropy"]).build()


#: The reference's other axes.  Its criterion "log-loss" is no valid name and its "auto" means "sqrt", so both would only repeat points.
SPLITTERS, LOOKS, MIN_SPLITS = ("best", "random"), ("all", "sqrt"), (2, 4, 6)
CCP_ALPHAS = tuple(round(float(a), 10) for a in np.linspace(0, 0.05, 10))
TREE_BINS = 64


def _tree_points() -> list[dict]:
    """Every point of the search: impurity, splitter, depth, least rows of a split, features a node looks at, cost-complexity alpha."""
    base = [{p.name: v for p, v in point.items()} for point in _dt_points()[1]]
    axes = product(base, SPLITTERS, LOOKS, MIN_SPLITS, CCP_ALPHAS)
    return [b | {"splitter": s, "maxFeatures": m, "minSamplesSplit": n, "ccpAlpha": a} for b, s, m, n, a in axes]


def _grown_trees(train, held, points, p):
    """Binned rows of both, ``held`` with its row numbers, the trees that ``points`` are parts of, and each kind's place."""
    rows, held = forest.forest_rows(train, held, "key", spread=True, n_bins=TREE_BINS)
    kinds = list(dict.fromkeys((q["impurity"], q["splitter"], q["maxFeatures"]) for q in points))
    many = {"all": p, "sqrt": ceil(sqrt(p))}
    trees = [level_trees.Tree(0, many[m], 1, i == "entropy", s == "random", bootstrap=False) for i, s, m in kinds]
    grown = level_trees.grow(rows, trees, max(q["maxDepth"] for q in points), SEED, TREE_BINS)
    return rows, held, grown, {kind: i for i, kind in enumerate(kinds)}


def _pruned(grown, places, q, alphas, held):
    tree = places[q["impurity"], q["splitter"], q["maxFeatures"]]
    return level_trees.pruned(grown, tree, q["impurity"] == "entropy", q["maxDepth"], q["minSamplesSplit"], alphas, held)


@query("dt_grid")
def dt_grid(spark, sf):
    """The reference's whole search, 720 points.  A smaller depth, a larger least split and a pruned tree are parts of one
    grown tree, so a fold grows eight, and the sums of their nodes give all accuracies."""
    d = model_data(spark, sf)
    points = _tree_points()

    def fold(split):
        rows, _, grown, places = _grown_trees(*split, points, len(d.feats))
        held = level_trees.held_counts(rows, grown, max(q["maxDepth"] for q in points))
        hits, found = {}, []
        for q in points:
            kind = tuple(q[c] for c in ("impurity", "splitter", "maxFeatures", "maxDepth", "minSamplesSplit"))
            if kind not in hits:
                hits[kind] = dict(zip(CCP_ALPHAS, _pruned(grown, places, q, np.array(CCP_ALPHAS), held)[1]))
            found.append(hits[kind][q["ccpAlpha"]] / held[0][0][0])
        return found

    found = side_by_side(fold, d.splits())
    return classify.grid_table(spark, points, [sum(a) / len(found) for a in zip(*found)])


def _tuned_tree(spark, d):
    """The search's best tree, grown on all training rows."""
    best = _tree_points()[_best(dt_grid(spark, d))]
    rows, test, grown, places = _grown_trees(d.train, d.test, [best], len(d.feats))
    split, _ = _pruned(grown, places, best, np.array([best["ccpAlpha"]]), (grown.total, grown.ones))
    grown.feature[0] = np.where(split[0], grown.feature[0], -1)
    scores = level_trees.scores(rows, grown, [([0], best["maxDepth"])])
    scored = test.join(scores.select(F.col("n").alias("_n"), F.col("scores")[0].alias("score")), "_n").drop("_n")
    return classify.metrics_row(scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")), "decision_tree_pre_pruned")


@query("cv_accuracy")
def cv_accuracy(spark, sf):
    """Held-out accuracy of each fold of the two-fold check, for every plain model."""
    d = model_data(spark, sf)
    models = {
        "decision_tree": DecisionTreeClassifier(maxDepth=30, maxBins=64, seed=SEED, **TREE_OPTS),
        "logistic_regression": LogisticRegression(maxIter=100, regParam=_reg(1.0, d.n_train), standardization=False),
        "linear_svm": LinearSVC(maxIter=100, regParam=_reg(1.0, d.n_train), standardization=False),
        "mlp": MultilayerPerceptronClassifier(layers=[len(d.feats), 10, 10, 2], maxIter=100, seed=SEED),
    }
    rows = [
        (name, fold, acc) for name, est in models.items() for fold, acc in enumerate(classify.k_fold(est, d.splits(CHECK_FOLDS)))
    ]
    out = spark.createDataFrame(rows, "model STRING, fold INT, accuracy DOUBLE")
    return out.select("model", "fold", round_even("accuracy", 6).alias("accuracy"))


# --------------------------------------------------------------------------- linear models

@query("logreg")
def logreg(spark, sf):
    d = model_data(spark, sf)
    est = LogisticRegression(maxIter=100, regParam=_reg(1.0, d.n_train), elasticNetParam=0.0, standardization=False)
    return classify.fit_score(est, d.train, d.test, "logistic_regression")[1]


def _logreg_points(n):
    est = LogisticRegression(maxIter=100, elasticNetParam=0.0, standardization=False)
    return est, ParamGridBuilder().addGrid(est.regParam, [_reg(c, n) for c in (0.01, 1.0, 10.0, 100.0)]).addGrid(est.maxIter, [100, 200]).build()


@query("logreg_grid")
def logreg_grid(spark, sf):
    d = model_data(spark, sf)
    est, grid = _logreg_points(d.n_train)
    return classify.grid_search(est, grid, d.splits())


@query("linear_svm")
def linear_svm(spark, sf):
    d = model_data(spark, sf)
    est = LinearSVC(maxIter=100, regParam=_reg(1.0, d.n_train), standardization=False)
    return classify.fit_score(est, d.train, d.test, "linear_svm")[1]


@query("rbf_svm_rff")
def rbf_svm_rff(spark, sf):
    """RBF kernel SVM (C=10, γ=1) approximated by 200 random Fourier features."""
    d = model_data(spark, sf)
    dim = len(d.feats)
    tr = classify.random_fourier_features(d.train.drop("features"), "v", dim, 200, 1.0, SEED)
    te = classify.random_fourier_features(d.test.drop("features"), "v", dim, 200, 1.0, SEED)
    est = LinearSVC(maxIter=100, regParam=_reg(10.0, d.n_train), standardization=False)
    return classify.fit_score(est, tr, te, "rbf_svm_rff")[1]


@query("poly_svm")
def poly_svm(spark, sf):
    """Polynomial kernel SVM (C=10) as an explicit degree-3 expansion + linear SVM."""
    d = model_data(spark, sf)
    pe = PolynomialExpansion(degree=3, inputCol="features", outputCol="poly")
    est = LinearSVC(maxIter=100, regParam=_reg(10.0, d.n_train), standardization=False, featuresCol="poly")
    return classify.fit_score(est, pe.transform(d.train), pe.transform(d.test), "poly_svm")[1]


# --------------------------------------------------------------------------- naive Bayes

def _unpacked(df, feats):
    return df.select("id", "label", *[F.col("v")[i].alias(f"f{i}") for i in range(len(feats))], *(["fold"] if "fold" in df.columns else []))


@query("gaussian_nb")
def gaussian_nb(spark, sf):
    d = model_data(spark, sf)
    names = [f"f{i}" for i in range(len(d.feats))]
    tr, te = _unpacked(d.train, d.feats), _unpacked(d.test, d.feats)
    params = bayes.fit_params(tr, "label", names, 1e-9)
    return classify.metrics_row(bayes.predict(te, params, names), "gaussian_nb")


SMOOTHINGS = (1e-9, 1e-5, 1e-3)


@query("gaussian_nb_grid")
def gaussian_nb_grid(spark, sf):
    """var_smoothing ∈ {1e-9, 1e-5, 1e-3}, judged on the folds' held-out rows."""
    d = model_data(spark, sf)
    names = [f"f{i}" for i in range(len(d.feats))]
    points = SMOOTHINGS
    accs = {s: [] for s in points}
    for train, held in d.splits():
        tr, te = _unpacked(train, d.feats), _unpacked(held, d.feats)
        plain = cut_lineage(bayes.fit_params(tr, "label", names, 0.0))
        for s in points:
            params = bayes.smoothed(plain, tr, names, s)
            hit = bayes.predict(te, params, names).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")))
            accs[s].append(float(hit.first()[0]))
    return _table(spark, [(f"var_smoothing={s}", sum(accs[s]) / len(accs[s])) for s in points])


def _table(spark, points):
    best = max(range(len(points)), key=lambda i: (points[i][1], -i))
    rows = [(i, p, float(m), i == best) for i, (p, m) in enumerate(points)]
    return spark.createDataFrame(rows, "point INT, params STRING, mean_accuracy DOUBLE, is_best BOOLEAN").select(
        "point", "params", round_even("mean_accuracy", 6).alias("mean_accuracy"), "is_best"
    )


# --------------------------------------------------------------------------- forests and ensembles

@query("random_forest")
def random_forest(spark, sf):
    d = model_data(spark, sf)
    return classify.metrics_row(ensemble.random_forest(d.train, d.test, "key", trees=100, depth=30, seed=SEED), "random_forest")


def _rf_points():
    est = RandomForestClassifier(seed=SEED, **TREE_OPTS)
    grid = ParamGridBuilder().addGrid(est.maxDepth, [3, 5]).addGrid(est.numTrees, [100, 200])
    return est, grid.addGrid(est.featureSubsetStrategy, ["1", "3"]).addGrid(est.minInstancesPerNode, [1, 3]).build()


@query("rf_grid")
def rf_grid(spark, sf):
    """Every fold grows one forest for each feature count and leaf size: fewer trees and smaller depths are parts of it."""
    d = model_data(spark, sf)
    points = [{p.name: v for p, v in point.items()} for point in _rf_points()[1]]
    shapes = [_rf_shape(p) for p in points]

    def fold(split):
        scores, _ = ensemble.forest_points(*split, "key", shapes, SEED)
        hit = [F.avg(((F.col("scores")[i] > 0.5) == (F.col("label") > 0)).cast("double")) for i in range(len(shapes))]
        return [float(a) for a in scores.agg(*(h.alias(f"a{i}") for i, h in enumerate(hit))).first()]

    found = side_by_side(fold, d.splits(FOREST_FOLDS))
    return classify.grid_table(spark, points, [sum(a) / len(found) for a in zip(*found)])


def _rf_shape(point: dict) -> tuple[int, int, int, int]:
    return point["numTrees"], point["maxDepth"], int(point["featureSubsetStrategy"]), point["minInstancesPerNode"]


def _tuned_forest(spark, d):
    best = {p.name: v for p, v in _rf_points()[1][_best(rf_grid(spark, d))].items()}
    scores, test = ensemble.forest_points(d.train, d.test, "key", [_rf_shape(best)], SEED)
    scored = test.join(scores.select(F.col("n").alias("_n"), F.col("scores")[0].alias("score")), "_n").drop("_n")
    return classify.metrics_row(scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")), "random_forest_after_grid")


def _importances(spark, sf):
    d = model_data(spark, sf)
    imp = ensemble.importances(d.train, "key", trees=100, depth=20, seed=SEED)
    rows = [(f, float(v)) for f, v in zip(d.feats, imp)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


@query("rf_importance")
def rf_importance(spark, sf):
    return _importances(spark, sf).orderBy("importance").select("feature", round_even("importance", 6).alias("importance"))


@query("rf_importance_select")
def rf_importance_select(spark, sf):
    imp = _importances(spark, sf)
    return imp.select("feature", round_even("importance", 6).alias("importance"), (F.col("importance") >= 0.01).alias("selected"))


@query("bagging_rf")
def bagging_rf(spark, sf):
    d = model_data(spark, sf)
    return classify.metrics_row(ensemble.bagging(d.train, d.test, "key", seed=SEED), "bagging_rf")


@query("stacking_rf")
def stacking_rf(spark, sf):
    d = model_data(spark, sf)
    return classify.metrics_row(ensemble.stacking(d.train, d.test, d.splits(), "key", seed=SEED), "stacking_rf")


@query("adaboost_rf")
def adaboost_rf(spark, sf):
    d = model_data(spark, sf)
    return classify.metrics_row(ensemble.adaboost(d.train, d.test, "key", seed=SEED), "adaboost_rf")


# --------------------------------------------------------------------------- MLP

@query("mlp")
def mlp(spark, sf):
    d = model_data(spark, sf)
    est = MultilayerPerceptronClassifier(layers=[len(d.feats), 10, 10, 2], maxIter=100, seed=SEED)
    return classify.fit_score(est, d.train, d.test, "mlp")[1]


def _mlp_points(p):
    """Layers and iterations of the quasi-Newton solver; layers and step sizes of gradient descent, the only solver that has any."""
    est = MultilayerPerceptronClassifier(seed=SEED)
    layers = [[p, 10, 10, 2], [p, 20, 20, 2]]
    newton = ParamGridBuilder().baseOn({est.solver: "l-bfgs"}).addGrid(est.layers, layers).addGrid(est.maxIter, [100, 200])
    descent = ParamGridBuilder().baseOn({est.solver: "gd", est.maxIter: 100}).addGrid(est.layers, layers).addGrid(est.stepSize, [0.03, 0.3])
    return est, newton.build() + descent.build()


@query("mlp_grid")
def mlp_grid(spark, sf):
    d = model_data(spark, sf)
    est, grid = _mlp_points(len(d.feats))
    return classify.grid_search(est, grid, d.splits())


# --------------------------------------------------------------------------- post-pruning (C3)

def _ccp(spark, sf):
    from scorewise.operators import prune

    d = model_data(spark, sf)
    model = DecisionTreeClassifier(impurity="gini", maxDepth=30, maxBins=64, seed=SEED, **TREE_OPTS).fit(d.train)
    nodes = prune.load_nodes(spark, model)
    counts = {
        "train": prune.leaf_label_counts(model, d.train),
        "test": prune.leaf_label_counts(model, d.test),
    }
    return prune.pruning_path(nodes, counts)


@query("dt_ccp_path")
def dt_ccp_path(spark, sf):
    rows = [(s, float(a), float(i), int(n)) for s, a, i, n, _ in _ccp(spark, sf)]
    df = spark.createDataFrame(rows, "step INT, ccp_alpha DOUBLE, impurity DOUBLE, n_leaves INT")
    return df.select("step", round_even("ccp_alpha", 9).alias("ccp_alpha"), round_even("impurity", 9).alias("impurity"), "n_leaves")


@query("dt_ccp_curve")
def dt_ccp_curve(spark, sf):
    """Train / test accuracy of every pruned subtree; best alpha = best test accuracy (first on ties)."""
    rows = [(s, float(a), int(n), float(acc["train"]), float(acc["test"])) for s, a, _, n, acc in _ccp(spark, sf)]
    best = max(rows, key=lambda r: (r[4], -r[0]))[0]
    out = [r + (r[0] == best,) for r in rows]
    df = spark.createDataFrame(out, "step INT, ccp_alpha DOUBLE, n_leaves INT, train_accuracy DOUBLE, test_accuracy DOUBLE, is_best BOOLEAN")
    return df.select(
        "step", round_even("ccp_alpha", 9).alias("ccp_alpha"), "n_leaves",
        round_even("train_accuracy", 6).alias("train_accuracy"), round_even("test_accuracy", 6).alias("test_accuracy"), "is_best",
    )


# --------------------------------------------------------------------------- KNN / SVM grids, leaderboard

NEIGHBOURS = (2, 3, 4)


@query("knn_grid")
def knn_grid(spark, sf):
    """k ∈ {2, 3, 4} scored with the stratified folds (one k-NN join per fold at max k)."""
    from scorewise.operators import neighbors

    d = model_data(spark, sf)
    ks = list(NEIGHBOURS)
    accs = {k: [] for k in ks}

    def fold(split):
        tr, va = split
        nn = neighbors.knn_join(va.select(F.col("key").alias("id"), "v"), tr.select(F.col("key").alias("id"), "v"), max(ks))
        votes = neighbors.vote(nn, tr.select(F.col("key").alias("id"), "label"), ks, "id", "label")
        truth = va.select(F.col("key").alias("qid"), "label")
        res = votes.join(truth, "qid").groupBy("k").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
        return res.collect()

    for rows in side_by_side(fold, d.splits()):
        for r in rows:
            accs[int(r["k"])].append(float(r["a"]))
    return _table(spark, [(f"k={k}", sum(accs[k]) / len(accs[k])) for k in ks])


KERNELS, GAMMAS, COSTS = ("rbf", "poly"), (1.0, 0.001), (0.1, 10.0)
#: Width of the sketch of the polynomial kernel.
SKETCH = 1024


#: Features of the RBF kernel.
FOURIER = 200
#: Bytes of features that the fits of a kernel keep at a time, if several run side by side.
KEPT = 2_000_000_000


def _kernel(kernel, gamma, dim, rows):
    """Rows whose features approximate the kernel.  They are made when they are read and never written: a row of them is
    up to 40 times as large as the row that they come from."""
    if kernel == "rbf":
        return classify.random_fourier_features(rows.select("label", "v"), "v", dim, FOURIER, gamma, SEED)
    if comb(dim + 3, 3) - 1 > SKETCH:  # more monomials than the sketch is wide
        return classify.tensor_sketch(rows.select("label", "v"), "v", dim, 3, SKETCH, gamma, SEED)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([gamma**0.5] * dim), inputCol="features", outputCol="_scaled")
    expand = PolynomialExpansion(degree=3, inputCol="_scaled", outputCol="_poly")
    return expand.transform(scale.transform(rows)).select("label", F.col("_poly").alias("features"))


def _width(kernel: str, dim: int) -> int:
    return FOURIER if kernel == "rbf" else min(SKETCH, comb(dim + 3, 3) - 1)


def _fits(n_rows: int, kernel: str, dim: int) -> int:
    """How many fits run side by side: each keeps its features, in memory or on disk, until it ends."""
    return max(1, min(4, KEPT // max(1, 8 * _width(kernel, dim) * n_rows)))


def _dealt(rows, kernel: str, dim: int, n_rows: int):
    """Rows in partitions of about 64 MB of features, and enough of them for all cores: small rows came in few."""
    parts = max(-(-n_rows * _width(kernel, dim) // 8_000_000), min(rows.sparkSession.sparkContext.defaultParallelism, n_rows // 1000))
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


@query("svm_grid")
def svm_grid(spark, sf):
    """Kernel SVM grid: RBF (random Fourier features) and degree-3 polynomial kernels, γ ∈ {1, 0.001} × C ∈ {0.1, 10}.

    The polynomial kernel is a tensor sketch, or all monomials where there are fewer of them than the sketch is wide."""
    d = model_data(spark, sf)
    dim = len(d.feats)
    points = []
    for kernel in KERNELS:
        for gamma in GAMMAS:
            splits = [(_kernel(kernel, gamma, dim, _dealt(train, kernel, dim, d.n_train)), _kernel(kernel, gamma, dim, held)) for train, held in d.splits()]
            many = len(splits) if _fits(d.n_train, kernel, dim) >= 4 else _fits(d.n_train, kernel, dim)
            for c in COSTS:
                est = LinearSVC(maxIter=100, regParam=_reg(c, d.n_train), standardization=False)
                accs = [a for at in range(0, len(splits), many) for a in classify.k_fold(est, splits[at : at + many])]
                points.append((f"kernel={kernel}, gamma={gamma}, C={c}", sum(accs) / len(accs)))
    return _table(spark, points)


@query("knn_model")
def knn_model(spark, sf):
    """KNN (k = 3, the reference's final choice) on the applicant features; score = share of class-1 votes."""
    return _knn(model_data(spark, sf), 3, "knn")


def _knn(d, k, name):
    from scorewise.operators import neighbors

    nn = neighbors.knn_join(d.test.select("id", "v"), d.train.select(F.col("key").alias("id"), "v"), k)
    labels = d.train.select(F.col("key").alias("nid"), F.col("label").alias("_nl"))
    votes = nn.join(labels, "nid").groupBy("qid").agg(F.avg("_nl").alias("score"))
    pred = votes.join(d.test.select(F.col("id").alias("qid"), "label"), "qid").withColumn(
        "prediction", (F.col("score") > 0.5).cast("double")
    )
    return classify.metrics_row(pred, name)


def _best(table) -> int:
    return table.filter("is_best").first()["point"]


def _tuned(d, name, est, grid):
    """The grid's best point, fitted to all training rows."""
    best = grid[_best(classify.grid_search(est, grid, d.splits()))]
    return classify.fit_score(est.copy(best), d.train, d.test, name)[1]


def _tuned_svm(spark, d):
    kernel, gamma, c = [(k, g, c) for k in KERNELS for g in GAMMAS for c in COSTS][_best(svm_grid(spark, d))]
    dim = len(d.feats)
    train, test = (_kernel(kernel, gamma, dim, rows) for rows in (_dealt(d.train, kernel, dim, d.n_train), d.test))
    est = LinearSVC(maxIter=100, regParam=_reg(c, d.n_train), standardization=False)
    return classify.fit_score(est, train, test, "svm_after_grid")[1]


def _tuned_nb(spark, d):
    names = [f"f{i}" for i in range(len(d.feats))]
    params = bayes.fit_params(_unpacked(d.train, d.feats), "label", names, SMOOTHINGS[_best(gaussian_nb_grid(spark, d))])
    return classify.metrics_row(bayes.predict(_unpacked(d.test, d.feats), params, names), "gaussian_nb_after_grid")


def _post_pruned(spark, d):
    """The pruned subtree of the best test accuracy (first on ties), as the reference chooses it."""
    from scorewise.operators import prune

    model = DecisionTreeClassifier(impurity="gini", maxDepth=30, maxBins=64, seed=SEED, **TREE_OPTS).fit(d.train)
    nodes, gone = prune.load_nodes(spark, model), []
    path = prune.pruning_path(nodes, {"test": prune.leaf_label_counts(model, d.test)}, gone)
    best = max(path, key=lambda r: (r[4]["test"], -r[0]))[0]
    return classify.metrics_row(prune.predict(spark, model, nodes, set(gone[:best]), d.test), "decision_tree_post_pruned")


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    """E8 over fitted models: the 18 rows of the reference's table, all on the same test split."""
    d = model_data(spark, sf)
    rows = [
        dt_basic(spark, d),
        _tuned_tree(spark, d),
        _post_pruned(spark, d),
        logreg(spark, d),
        _tuned(d, "logistic_regression_after_grid", *_logreg_points(d.n_train)),
        _knn(d, 2, "knn"),
        _knn(d, NEIGHBOURS[_best(knn_grid(spark, d))], "knn_after_grid"),
        linear_svm(spark, d),
        _tuned_svm(spark, d),
        gaussian_nb(spark, d),
        _tuned_nb(spark, d),
        random_forest(spark, d),
        _tuned_forest(spark, d),
        bagging_rf(spark, d),
        adaboost_rf(spark, d),
        stacking_rf(spark, d),
        mlp(spark, d),
        _tuned(d, "mlp_after_grid", *_mlp_points(len(d.feats))),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
