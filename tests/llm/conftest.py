from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

LETTERS = ["the", "of", "thin", "and", "er", "on", "tion", "wh", "ea", "st", "É", "ñ", "ou", "re"]


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choices(LETTERS, k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, long, equal and near-equal texts; equal and null ids; columns with clashing names."""
    rnd = random.Random(3)
    base, other, passage = words(rnd, 120), words(rnd, 200), words(rnd, 60)
    long = words(rnd, 20_000)
    near = base.replace("and", "und", 1)
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "a"), (7, "A b"), (8, "a B"), (9, long), (10, long + " end"),
        (11, other + " " + passage), (12, passage + " " + words(rnd, 90)), (13, "x" * 5000), (14, " \t\n "), (15, words(rnd, 4) + " ab " * 100),
        (16, "don't  stop\n\n 'tis 12 ³ 日本 😀"), (None, other), (None, None), (17, base), (17, other), (17, base), (18, words(rnd, 100)), (-3, words(rnd, 100)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("uid"), F.lit(1).alias("score"), F.lit(2).alias("spans"), F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
