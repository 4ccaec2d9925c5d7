"""Trees of bounded depth: against growth one node at a time, and their use in the grids."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from scorewise.operators import forest, level_trees
from scorewise.operators.level_trees import Tree
from scorewise.plans import classifiers


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4)).round(2)
    x[:, 3] = x[:, 3] > 1
    y = ((x[:, 0] + x[:, 1] ** 2 + 0.5 * rng.normal(size=500)) > 0.8).astype(float)
    rows = [(int(i), int(i), float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, id long, label double, a double, b double, c double, d double")
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    return df.filter("id < 400").cache(), df.filter("id >= 400").cache()


def _cost(total, ones, entropy):
    if not entropy:
        return total * (1 - (ones / total) ** 2 - ((total - ones) / total) ** 2)
    return -sum(x * np.log2(x / total) for x in (ones, total - ones) if x)


def by_hand(tree, seed, depth, data, w, min_split=2):
    """Class-1 share of every row's leaf."""
    out = np.zeros(len(w))
    todo = [(forest._root(forest.Forest(seed=seed), 0, tree.number), np.arange(len(w)), 0)]
    while todo:
        node, rows, level = todo.pop()
        total, ones = w[rows].sum(), (w * data["label"])[rows].sum()
        best = (1e-9, None, None)
        if level < depth and total >= min_split and 0 < ones < total:
            for f in forest._looked_at(np.array([node], np.uint64), data["bins"].shape[1], tree.looks)[0]:
                for cut in range(int(data["bins"].max())):
                    left = rows[data["bins"][rows, f] <= cut]
                    a, a1 = w[left].sum(), (w * data["label"])[left].sum()
                    if min(a, total - a) >= tree.least:
                        gain = _cost(total, ones, tree.entropy) - _cost(a, a1, tree.entropy) - _cost(total - a, ones - a1, tree.entropy)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
        if best[1] is None:
            out[rows] = ones / total if total else 0.5
            continue
        right = data["bins"][rows, best[1]] > best[2]
        children = forest._children(np.array([node], np.uint64))
        todo += [(children[0], rows[~right], level + 1), (children[1], rows[right], level + 1)]
    return out


@pytest.mark.parametrize("kind", [{}, {"least": 5}, {"entropy": True, "bootstrap": False}, {"looks": 4, "least": 3}])
def test_trees_against_hand(points, kind):
    rows, _ = forest.forest_rows(*points, "key", spread=True)
    trees = [Tree(number, **{"looks": 2} | kind) for number in range(3)]
    grown = level_trees.grow(rows.repartition(3), trees, 4, 7)
    data = forest._arrays(rows.toArrow())
    ws = [data["weight"] * (forest._draws(data["h"], forest._root(forest.Forest(seed=7), 0, t.number)) if t.bootstrap else 1) for t in trees]
    parts = [([0, 1, 2], 4), ([0, 1], 2), ([1], 4)]  # smaller depths and fewer trees are parts of the same growth
    got = {r["n"]: r["scores"] for r in level_trees.scores(rows, grown, parts).collect()}
    want = [np.mean([by_hand(trees[t], 7, depth, data, ws[t]) for t in members], axis=0) for members, depth in parts]
    held = data["scored"]
    assert len(got) == held.sum() == 100
    assert np.allclose([got[n] for n in data["n"][held]], np.array(want)[:, held].T)


def test_rf_grid_grows_no_forest_of_spark(spark, points, monkeypatch):
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a forest of Spark"))
    train, test = points
    d = classifiers.ModelData(train, train, test, list("abcd"))
    d.splits = lambda folds: [(train, test), (train.filter("id >= 100"), train.filter("id < 100"))]
    got = classifiers.rf_grid(spark, d).orderBy("point").collect()
    assert [r["params"] for r in got][:2] == [f"featureSubsetStrategy=1, maxDepth=3, minInstancesPerNode={n}, numTrees=100" for n in (1, 3)]
    assert len(got) == 16 and sum(r["is_best"] for r in got) == 1 and all(0.6 < r["mean_accuracy"] <= 1 for r in got)
    assert classifiers._tuned_forest(spark, d).first()["model"] == "random_forest_after_grid"


def test_drawn_cuts_and_cut_off_trees(points):
    """A larger least split is a cut-off tree; pruning takes all that costs less than alpha; drawn cuts lie within the node's values."""
    rows, _ = forest.forest_rows(*points, "key", spread=True, n_bins=64)
    trees = [Tree(0, 4, bootstrap=False), Tree(0, 4, entropy=True, drawn_cut=True, bootstrap=False)]
    grown = level_trees.grow(rows, trees, 5, 7, 64)
    data = forest._arrays(rows.toArrow())
    held = level_trees.held_counts(rows, grown, 5)
    assert held[0][:, 0].tolist() == [100, 100]
    for least, depth in ((2, 5), (40, 5), (2, 2)):
        want = by_hand(trees[0], 7, depth, data, data["weight"], least) > 0.5
        hits = level_trees.pruned(grown, 0, False, depth, least, np.array([0.0]), held)[1]
        assert hits[0] == (want == data["label"])[data["scored"]].sum()
    split, hits = level_trees.pruned(grown, 0, False, 5, 2, np.array([0.0, 0.01, 1.0]), held)
    assert split[0].sum() > split[1].sum() > split[2].sum() == 0 and not (split[1] & ~split[0]).any()
    total, ones = grown.total[0], grown.ones[0]
    r = level_trees.impurity(total, ones, False) / total[0]
    for node in np.flatnonzero(split[1]):  # each kept subtree takes away more than alpha a leaf
        below, todo = [], [node]
        while todo:
            t = todo.pop()
            if split[1][t]:
                todo += [2 * t + 1, 2 * t + 2]
            else:
                below.append(t)
        assert (r[node] - r[below].sum()) / (len(below) - 1) > 0.01
    at = np.flatnonzero(grown.feature[1] >= 0)
    assert len(at) and (grown.total[1][2 * at + 1] > 0).all() and (grown.total[1][2 * at + 2] > 0).all()


def test_dt_grid_searches_all_axes(spark, points):
    train, test = points
    d = classifiers.ModelData(train, train, test, list("abcd"))
    d.splits = lambda folds=5: [(train, test), (train.filter("id >= 100"), train.filter("id < 100"))]
    got = [r["params"] for r in classifiers.dt_grid(spark, d).collect()]
    assert len(set(got)) == 2 * 3 * 2 * 2 * 3 * 10
    assert got[0] == "ccpAlpha=0.0, impurity=gini, maxDepth=2, maxFeatures=all, minSamplesSplit=2, splitter=best"
    row = classifiers._tuned_tree(spark, d).first()
    assert row["model"] == "decision_tree_pre_pruned" and row["accuracy"] > 0.6
