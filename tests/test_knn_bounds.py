"""The k-NN join sends a query row to few cells, and loses no neighbour."""

from __future__ import annotations

import numpy as np

from scorewise.operators import neighbors


def test_few_cells_are_visited(spark, monkeypatch):
    """Four far clumps: query rows stay in theirs.  Before, a bound came from a cell's radius only, and each block got a copy."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 3)) + 50 * i for i in range(4)])
    q = x[::10] + rng.normal(size=(200, 3)) * 0.1
    piv = x[::50]
    d2 = neighbors._squares_to(x, piv)
    cell, far = d2.argmin(1), np.sqrt(d2.min(1))
    cells = neighbors.Cells([{"cell": c, "n": (cell == c).sum(), "inner": far[cell == c].min(), "radius": far[cell == c].max()} for c in np.unique(cell)], piv, 3)
    at = neighbors._squares_to(q, piv)
    dist = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    bound = np.array([np.sort(dist[i][np.isin(cell, cells.cells[h])])[2] for i, h in enumerate(cells.home(at))])
    reach = cells.reach(q, at, bound)
    for i in range(len(q)):  # every cell with one of the three nearest rows is at home or in reach
        assert set(cell[np.argsort(dist[i])[:3]]) <= {*cells.cells[reach[i]]}
    assert reach.sum(1).mean() < 10 < len(cells.cells) == 40


def test_join_with_ties_copies_and_hot_cells(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((60, 2)), rng.integers(0, 3, size=(140, 2)).astype(float), rng.normal(size=(100, 2)) * 9])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbors.knn_join(rows, rows, 4, exclude_self=True, n_pivots=12, block_rows=16).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["nid"], r["distance"])
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:4]
        assert [got[i][r + 1] for r in range(4)] == [(j, d[j]) for j in want]


def test_known_bounds_need_no_sorting(monkeypatch):
    rng = np.random.default_rng(4)
    x, y, ids = rng.normal(size=(50, 4)), rng.normal(size=(900, 4)), np.arange(900)
    dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    monkeypatch.setattr(neighbors, "TILE", 128)
    monkeypatch.setattr(neighbors.np, "partition", lambda *a, **k: 1 / 0)
    qid, nid, d = neighbors.block_top(ids[:50], x, ids, y, 3, bound=np.sort(dist)[:, 2])
    for i in range(50):
        mine = np.lexsort((nid[qid == i], d[qid == i]))[:3]
        assert nid[qid == i][mine].tolist() == np.argsort(dist[i])[:3].tolist()
