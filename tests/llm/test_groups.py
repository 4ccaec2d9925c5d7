"""Duplicates, repeats and leaks against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewise.llm import decontam, embed_dups, minhash, suffix_dups
from scorewise.llm.common import with_uid
from scorewise.llm.components import components
from tests.llm.conftest import words


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_components(spark):
    rnd = random.Random(0)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(501, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, odd_docs, k):
    rows = [(r["uid"], r["id"], r["text"]) for r in with_uid(odd_docs).distinct().orderBy("uid").collect()]
    sets = [shingles(t, k) for _, _, t in rows]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(len(rows), links)
    got = {r["uid"]: r for r in minhash.near_duplicates(odd_docs, words=k).distinct().collect()}
    assert len(got) == len(rows)
    for i, (uid, _, _) in enumerate(rows):
        assert got[uid]["n_shingles"] == len(sets[i])
        assert got[uid]["component"] == rows[want[i]][0]
        assert got[uid]["component_id"] == rows[want[i]][1]


def test_near_copies_in_blocks(spark, monkeypatch):
    """Small limits send lists through pairs of coordinates and blocks; the groups stay the same."""
    rnd = random.Random(8)
    common = words(rnd, 80).split()
    rows = []
    for i in range(120):
        text = list(common)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = words(rnd, 1)
        rows.append((i, " ".join(text)))
    rows += [(200 + i, words(rnd, 60)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["id"]: r["component"] for r in minhash.near_duplicates(docs, words=2).collect()}
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)
    assert {r["id"]: r["component"] for r in minhash.near_duplicates(docs, words=2).collect()} == plain
    sets = [shingles(t, 2) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert plain == {rows[i][0]: rows[r][0] for i, r in enumerate(roots(len(rows), links))}


def repeats_by_force(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_repeats(odd_docs, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dups, "CROWDED", crowded)
    docs = with_uid(odd_docs)
    rows = docs.distinct().orderBy("uid").collect()
    want = dict(zip([r["uid"] for r in rows], repeats_by_force([r["text"] for r in rows])))
    got = suffix_dups.removed(docs, suffix_dups.repeats(docs)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["uid"]]


@pytest.mark.parametrize("at_once, crowded", [(130, 1000), (77, 1)])
def test_long_texts_in_slices(spark, monkeypatch, at_once, crowded):
    """Texts longer than a slice (lowered here) lose the same bytes; a crowded context leaves a task once."""
    monkeypatch.setattr(suffix_dups, "SLICE", at_once)
    monkeypatch.setattr(suffix_dups, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dups, "REMEMBERED", 5)
    rng = random.Random(7)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [f"{i} start " * (i % 3) + shared + f" end {i}" * (i % 4) for i in range(40)]
    texts += ["ab" * 400, "x" * 99, "x" * 100, "x" * 700, None, "", shared[50:300] + shared]
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").withColumn("id", F.col("uid"))
    got = suffix_dups.removed(docs, suffix_dups.repeats(docs)).collect()
    assert {r["id"]: bytes(r["kept"]) for r in got} == _without_repeats(texts)


def test_equal_contexts_are_remembered():
    seen = suffix_dups.Remembered(2)
    assert not seen.later(1, 1, 5, 0, b"a")
    assert seen.later(1, 1, 6, 0, b"a") and not seen.later(1, 1, 6, 0, b"b")  # equal hash, other bytes
    assert not seen.later(1, 1, 4, 0, b"a") and seen.later(1, 1, 5, 0, b"a")  # an earlier one comes late
    assert not seen.later(2, 1, 9, 0, b"a") and not seen.later(3, 1, 9, 0, b"a") and not seen.later(1, 1, 9, 0, b"a")  # emptied


def _without_repeats(texts):
    known, out = set(), {}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in known:
                gone[at : at + 100] = True
            known.add(raw[at : at + 100])
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def test_cut_texts(odd_docs, no_docs):
    got = suffix_dups.cut_texts(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in got.collect()}[2] == ""
    assert suffix_dups.cut_texts(no_docs).count() == 0


def test_tiles_prefer_long_matches_and_never_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item = rng.integers(0, 4, 30).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 4, 20), item[15:], rng.integers(0, 4, 5), item[:15]]).astype(np.uint64)
        seeds = np.arange(len(doc) - 4)
        got = decontam.tiles(doc, item, seeds, 5)
        for side in (0, 1):
            used = [x for t in got for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        for i, j, n in got:
            assert n >= 5 and (doc[i : i + n] == item[j : j + n]).all()
        longest = max((n for i in range(len(doc)) for j in range(len(item)) for n in [_run(doc, item, i, j)]), default=0)
        assert max((n for _, _, n in got), default=0) == (longest if longest >= 5 else 0)


def _run(doc, item, i, j):
    n = 0
    while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
        n += 1
    return n


def test_leaks(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(11)
    items = [words(rnd, 30) for _ in range(6)]
    w = items[2].split()
    moved = " ".join(w[15:] + ["and"] + w[:15]).upper()
    docs = spark.createDataFrame([(100, words(rnd, 50) + " " + items[0] + "! " + words(rnd, 9)), (101, moved), (102, " ".join(items[1].split()[:9])), (None, items[3]), (100, items[4])], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(8, None, "x"), (9, "of", "x"), (None, "", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()}
    assert got == {(100, 0), (101, 2), (None, 3), (100, 4)}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == got
    assert decontam.matches(odd_docs, bench).count() == 0
    assert decontam.matches(no_docs, bench).count() == 0
    assert decontam.matches(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dups, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        rows.append((i, (rng.normal(size=16)).tolist(), i % 2))
    hub = rng.normal(size=16)
    rows += [(100 + i, (hub + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(40)]
    rows += [(200, hub.tolist(), 1), (201, hub.tolist(), 1), (202, (hub * 3).tolist(), 1), (203, hub.tolist(), None), (204, None, 1), (205, [0.0] * 16, 1)]
    rows += [(206, [None, 1.0], 1), (207, [float("nan"), 1.0], 1), (208, [1.0, 2.0], 1), (209, [], 1), (None, hub.tolist(), 1), (200, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(tuple(r) for r in embed_dups.near_vectors(df).fillna(-1, ["vec_id", "component_id"]).collect())
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and k is not None for _, v, k in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = (np.array(np.array(rows[i][1], np.float32), float) for i in (a, b))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    root = roots(len(rows), links)
    want = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids) if usable[i] and ids else vec_id
        want.append((-1 if vec_id is None else vec_id, sum(i in x for x in links), -1 if component is None else component, vec_id is not None and vec_id == component))
    found, true = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found >= 0.9 * true and all(g[1] <= w[1] for g, w in zip(got, sorted(want)))
    assert [g[2:] for g in got] == [w[2:] for w in sorted(want)]
    assert embed_dups.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_matrices_of_odd_vectors(kind):
    """Null, empty, zero, non-finite vectors and those with null components stay out; a slice keeps its own rows."""
    rows = [[9.0], [1.0, -0.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf")], [3.0, 4.0], [2.0], [5.0, 6.0]]
    vectors = pa.array(rows, pa.list_(kind)).slice(1)
    wanted = np.array([True] * 9 + [False])
    got = [(at.tolist(), x.tolist()) for at, x in embed_dups._matrices(vectors, wanted)]
    assert got == [([8], [[2.0]]), ([0, 7], [[1.0, 0.0], [3.0, 4.0]])]
    assert list(embed_dups._matrices(vectors.slice(0, 0), wanted[:0])) == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((embed_dups.hadamard(x) ** 2).sum(axis=1), 32 * (x**2).sum(axis=1))


def test_word_bounds():
    data = np.frombuffer(b" a bc\x0bd", np.uint8)
    start, end, row = minhash.word_bounds(data, np.array([0, 2, 2, len(data)]))
    assert [(int(a), int(b), int(r)) for a, b, r in zip(start, end, row)] == [(1, 2, 0), (3, 5, 2), (6, 7, 2)]
    assert len(minhash.shingle_sets(pa.array([None, ""], pa.string()), 2)[0]) == 0
