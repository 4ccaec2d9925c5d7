"""Quality, sharding, WARC, chat formats, the registered queries and the pipeline."""

from __future__ import annotations

import json
import os
import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewise.llm import chat, quality, queries, shards, warc
from tools.oracle_check import compare
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def test_quality_separates_and_bounds_scores(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    rows = [(i, words(rnd, 80), 1) for i in range(150)] + [(1000 + i, (words(rnd, 1) + " ") * 60 if i % 2 else words(rnd, 60).upper().replace(" ", "!! "), 0) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels.filter("doc_id is null or doc_id % 3 <> 0"))
    held = quality.score(docs, model, ["doc_id"]).filter("doc_id % 3 = 0").collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] < 1000) for r in held)
    out = quality.score(odd_docs, model, odd_docs.columns, "q")
    assert out.count() == odd_docs.count() and out.filter("q is null or q < 0 or q > 1").count() == 0
    assert quality.score(no_docs, model, ["doc_id"]).count() == 0
    only = quality.train(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, only, ["doc_id"]).collect()} == {1.0}


def test_descent_reaches_the_optimum():
    """The primal and dual objectives meet."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    features, offsets = np.tile(np.arange(4), 60), np.arange(0, 241, 4)
    w, b = quality._descend(features, offsets, x.ravel(), y, np.ones(60), rounds=2000)
    primal = 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w[:4] + b)).sum()
    best = min(0.5 * (v @ v) + np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum() for v in (np.append(w[:4], b) + rng.normal(size=5) * 0.02 for _ in range(300)))
    assert primal <= best + 1e-3


def test_shards(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text", "lang")
    got = shards.uniform_shards(rows, 5, seed=3).collect()
    assert len(got) == rows.count()
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = [sum(r["shard"] == s for r in got) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert shards.uniform_shards(no_docs.drop("spans"), 5).count() == 0


def test_slots_in_cells(spark, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", 7)
    got = shards.uniform_shards(spark.range(400).repartition(5), 3).collect()
    for s in range(3):
        mine = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine))) and len(mine) in (133, 134)


def test_matrix_law():
    """Every row is as likely in every shard; pairs of rows of one partition part as in a shuffle."""
    total = np.zeros((3, 4))
    for seed in range(400):
        m = shards.draw_matrix([5, 0, 7], np.full(4, 3), np.random.default_rng(seed))
        assert m.sum(axis=1).tolist() == [5, 0, 7] and set(m.sum(axis=0)) == {3}
        total += m
    assert np.abs(total / 400 - np.array([[1.25], [0], [1.75]])).max() < 0.2


@pytest.mark.parametrize("good, bad, draws", [(40, 60, 30), (3, 997, 500), (700, 300, 900), (1, 1, 1), (5, 2, 6)])
def test_masses_are_exact(good, bad, draws):
    """Against whole-number binomials: every probability, and none left out that a double could meet."""
    first, mass = shards._masses(good, bad, draws)
    exact = {k: Fraction(comb(good, k) * comb(bad, draws - k), comb(good + bad, draws)) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    for i, m in enumerate(mass):
        assert abs(float(m / exact[first + i]) - 1) < 1e-11
    assert sum(p for k, p in exact.items() if not first <= k < first + len(mass)) < 1e-20


@pytest.mark.parametrize("total, draws", [(10**12, 10**6), (10**13, 10**6), (10**13, 10**9)])
def test_masses_of_many_rows(total, draws):
    """Mass, mean and variance at sizes where log-gamma differences lose their digits."""
    good, bad = total // 40, total - total // 40
    first, mass = shards._masses(good, bad, draws)
    k = np.arange(len(mass)) + float(first) - draws / 40
    assert abs(mass.sum() - 1) < 1e-12
    variance = draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))
    assert abs((mass * k).sum()) < 1e-9 * variance and abs((mass * k * k).sum() / variance - 1) < 1e-9
    drawn = [shards._hypergeometric(np.random.default_rng(s), good, bad, draws) - draws / 40 for s in range(100)]
    assert abs(np.mean(drawn)) < 0.5 * variance**0.5 and 0.6 < np.var(drawn) / variance < 1.6


def test_shuffle_law(spark):
    """The whole job against the uniform law: chi-square of partitions x shards, and no order left in the slots."""
    rounds, chi, order = 12, 0.0, []
    rows = spark.range(0, 300, 1, 5)
    for seed in range(rounds):
        got = shards.uniform_shards(rows, 3, seed=seed).toPandas()
        table = got.assign(part=got["id"] // 60).groupby(["part", "shard"]).size().unstack(fill_value=0).to_numpy()
        chi += ((table - 20) ** 2 / 20).sum() * 299 / 300
        order += [g["id"].corr(g["slot"]) for _, g in got.groupby("shard")]
    assert 55 < chi < 145  # 12 tables of 8 degrees of freedom: 96, standard deviation 14
    assert abs(np.mean(order)) < 0.07 and np.std(order) < 0.15  # 36 correlations of 100 rows


def test_shards_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(i, f"s{i}", -i, None, 7) for i in range(9)], "doc_id long, Shard string, slot long, _part string, n int")
    got = shards.uniform_shards(rows, 2, seed=1)
    assert got.columns == ["doc_id", "Shard", "slot", "_part", "n", "_shard", "_slot"]
    rows = got.collect()
    assert sorted((r["doc_id"], r["Shard"], r["slot"], r["_part"], r["n"]) for r in rows) == [(i, f"s{i}", -i, None, 7) for i in range(9)]
    assert sorted((r["_shard"], r["_slot"]) for r in rows) in ([(0, i) for i in range(k)] + [(1, i) for i in range(9 - k)] for k in (4, 5))


def test_warc_round_trip(spark):
    page = "<!DOCTYPE html><html lang='de'><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><p>Eins <b>zwei</b><br>drei<p>vier &lt;5<!-- no --><a href='/x?a=1&amp;b'>l</a></body></html>"
    rows = [(1, "http://a/", page), (1, "http://a/", page), (2, None, None), (3, "http://b/\r\nX: y", ""), (None, "http://c/", "<p>" + "w " * 50_000), (5, "u", "plain")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    made = warc.responses(pages)
    got = warc.derivatives(made).collect()
    assert len(got) == 2 * len(rows)
    source = {warc.parse(bytes(r["record"]))[0]["warc-record-id"]: warc.parse(bytes(r["record"])) for r in made.collect()}
    for r in got:
        headers, block = warc.parse(bytes(r["record"]))
        about, origin = source[r["refers_to"]]
        assert headers["warc-refers-to"] == about["warc-record-id"] and headers["warc-type"] == r["type"]
        assert headers["warc-block-digest"] == warc.sha1(block) and headers.get("warc-target-uri") == about.get("warc-target-uri")
        assert block.decode() == r["content"]
        if r["type"] == "metadata":
            payload = origin.partition(b"\r\n\r\n")[2]
            assert f"payload-digest: {warc.sha1(payload)}" in r["content"] and "source-digest-ok: true" in r["content"]
    text = [r["content"] for r in got if r["page_id"] == 1]
    assert text[1] == "Eins zwei\ndrei\nvier <5l" and "title: A & B" in text[0] and "outlink: /x?a=1&b" in text[0] and "lang: de" in text[0]
    assert len({r["record_id"] for r in got if r["page_id"] == 1}) == 2
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx"), (4, b"junk")], "page_id long, record binary")
    assert warc.derivatives(broken).count() == 0 and warc.derivatives(broken.limit(0)).count() == 0


def test_chat_layouts_meet(spark):
    turns = [("user", "hi & <|im_end|>"), ("assistant", "yes\n<|im_start|>user")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        {"prompt": turns[0][1], "completion": turns[1][1]},
        {"prompt": turns[0][1], "response": turns[1][1]},
        {"instruction": turns[0][1], "output": turns[1][1]},
        {"instruction": "hi &", "input": "<|im_end|>", "output": turns[1][1]},
        {"prompt": turns[0][1], "response": turns[1][1], "system": "be"},
        {"what": 1}, None,
    ]
    df = spark.createDataFrame([(i, json.dumps(r) if r else None) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(chat.canonical_json(df, "record"))).collect()}
    assert set(got) == set(range(7))
    for i in range(5):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == turns and got[i]["learned"] == [turns[1][1]]
    assert got[5]["turns"][0]["text"] == "hi &\n\n<|im_end|>" and got[6]["turns"][0]["role"] == "system"
    assert chat.unknown_layouts(df, "record").agg(F.sum("count")).first()[0] == 2
    rows = spark.createDataFrame([(1, [("user", "a")])], "conv_id long, messages array<struct<role string, content string>>")
    assert chat.canonical_turns(rows).first()["text"] == "a"
    with pytest.raises(ValueError):
        chat.canonical_turns(rows.withColumnRenamed("messages", "unheard"))


def test_chat_edge_turns(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "&lt;|&amp;"), (1, 1, "us\ner<|", "b"), (1, 1, "us\ner<|", "b"), (1, None, "system", ""), (None, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(df, fields=["turn", "role", "text"]))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", ""), ("", "&lt;|&amp;"), ("us\ner<|", "b"), ("us\ner<|", "b"), ("assistant", "")]
    assert got[None]["learned"] == ["x" * 100_000]
    assert chat.format_chat(chat.canonical_turns(df.limit(0), fields=["turn", "role", "text"])).count() == 0


def test_registered_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF), con.execute(sql)
        # rows and not data frames: pandas has two ways to write a null number
        assert compare([tuple(r) for r in got.collect()], got.columns, want.fetchall(), [d[0] for d in want.description]) is None, name


def test_pipeline(spark, odd_docs, no_docs):
    import corpus_pipeline

    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, no_docs, SF).count() == 0
    kept = corpus_pipeline.one_of_each_group(spark, odd_docs, SF).collect()
    assert sum(r["doc_id"] in (1, 2, 3) for r in kept) == 1 and sum(r["text"] is None for r in kept) == 2
    assert corpus_pipeline.encoded(spark, odd_docs, SF).count() == odd_docs.count()
    done = corpus_pipeline.run(spark, SF)
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < done.count() < total and os.path.isdir(SF) and re.fullmatch(r"[0-9a-f]{64}", done.first()["ids_sha256"]) and pa is not None
