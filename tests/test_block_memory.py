"""Blocks of row pairs are worked off in pieces: a task's memory doesn't grow with the block."""

import tracemalloc

import numpy as np

from scorewise.operators import cluster, neighbors


def test_knn_block_in_bounded_memory():
    rng = np.random.RandomState(3)
    x, y = rng.normal(size=(4096, 16)), rng.normal(size=(4096, 16))
    y[100:200] = y[0]  # ties
    ids = np.arange(4096)
    tracemalloc.start()
    qid, nid, dist = neighbors.block_top(ids, x, ids, y, 3, exclude_self=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # one matrix of all pairs is 134 MB
    for q in (0, 150, 2048, 4095):
        d = np.sqrt(((y - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((ids, d))[:3]
        assert nid[qid == q].tolist() == want.tolist()
        assert np.allclose(dist[qid == q], d[want], rtol=1e-12)


def test_silhouette_blocks_hold_tiles_only():
    rng = np.random.RandomState(4)
    x, y = rng.normal(size=(3000, 8)) + 1e3, rng.normal(size=(5000, 8)) + 1e3
    y[:40] = x[:40] + 1e-7  # so close that |a|² + |b|² - 2ab loses all digits
    y[40] = x[40]
    il, ir = (np.eye(3)[np.arange(len(v)) % 3] for v in (x, y))
    tracemalloc.start()
    left, right = cluster.block_sums(x, il, y, ir)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all pairs are 120 MB
    for r in (0, 39, 40, 2999):
        assert np.allclose(left[r], np.sqrt(((y - x[r]) ** 2).sum(1)) @ ir, rtol=1e-10)
        assert np.allclose(right[r], np.sqrt(((x - y[r]) ** 2).sum(1)) @ il, rtol=1e-10)
    close = cluster.distances(x[:41] - 1e3, y[:41] - 1e3).diagonal()
    assert np.allclose(close, np.sqrt(((x[:41] - y[:41]) ** 2).sum(1)), rtol=1e-6) and close[40] == 0


def test_silhouette_with_repeated_ids_small_blocks_and_no_label(spark):
    rng = np.random.RandomState(5)
    rows = [(i % 50, rng.normal(size=4).tolist(), int(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    one, many = (cluster.silhouette(df, ["label"], block_rows=b).first()["silhouette"] for b in (1000, 7))
    assert abs(one - many) < 1e-12
    plain = spark.createDataFrame([(100 + i, v, c) for i, (_, v, c) in enumerate(rows)] + [(900, rows[0][1], None)], df.schema)
    got = cluster.silhouette(plain, ["label"], block_rows=7).first()["silhouette"]
    x, c = np.array([v for _, v, _ in rows]), np.array([k for *_, k in rows])
    d, s = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), [0.0]  # a row without a label scores 0
    for i in range(60):
        a, b = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1), min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-12
