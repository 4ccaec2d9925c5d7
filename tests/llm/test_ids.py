"""Documents whose ids are not whole numbers: ranked in their order, results as with numbers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scorewise.llm import minhash, suffix_dups
from scorewise.llm.common import with_uid
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def numbered(spark):
    rnd = random.Random(11)
    base, passage = words(rnd, 80), words(rnd, 50)
    texts = [base, words(rnd, 90) + passage, base, passage + words(rnd, 40), None, "", base.replace("and", "und", 1)] + [words(rnd, 30) for _ in range(20)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()


def test_ranks_have_no_gaps(spark, numbered):
    named = numbered.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    got = with_uid(named).collect()
    assert sorted((r["uid"], r["id"]) for r in got) == [(i, f"d{i:03d}") for i in range(27)]
    half = with_uid(numbered.withColumn("doc_id", F.col("doc_id") / 2)).collect()
    assert sorted((r["uid"], r["id"]) for r in half) == [(i, i / 2) for i in range(27)]
    assert with_uid(named.limit(0)).count() == 0
    twice = with_uid(named.unionAll(named.withColumn("text", F.lit("other"))).unionAll(named.limit(3))).collect()
    assert {r["uid"] for r in twice} == set(range(54)) and len(twice) == 57


def test_results_do_not_depend_on_the_type(numbered):
    named = numbered.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    plain, other = ({r["uid"]: r.asDict() for r in minhash.near_duplicates(d).collect()} for d in (numbered, named))
    assert any(r["component"] != r["uid"] for r in plain.values())
    for uid, row in plain.items():
        assert other[uid] == row | {"id": f"d{uid:03d}", "component_id": f"d{row['component_id']:03d}"}
    plain, other = ({r["doc_id"]: r["text"] for r in suffix_dups.cut_texts(d).collect()} for d in (numbered, named))
    assert other == {f"d{k:03d}": v for k, v in plain.items()} and plain[2] == ""
