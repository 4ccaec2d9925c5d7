"""String tiling of scripts without spaces and of Unicode punctuation."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from scorewise.llm import decontam, minhash

ITEMS = [
    "春天的时候河边的柳树慢慢变绿，孩子们在桥上看船。",
    "古い寺の庭には大きな池があり、カメが石の上で眠っている。",
    "แม่น้ำสายนี้ไหลผ่านหมู่บ้านเล็กๆก่อนจะออกสู่ทะเล",
    "alpha\u00a0beta\u2014gamma\u3000delta\u201cepsilon\u201d zeta",
]


def test_items_of_unspaced_scripts_are_found(spark):
    texts = ["我昨天读到" + ITEMS[0] + "这是开头", "昔話：" + ITEMS[1] + "と言った", "ก่อน" + ITEMS[2] + "หลัง", "so alpha beta gamma delta epsilon zeta so", "完全不同的一句话没有任何重复内容存在于此"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = decontam.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(4)}
    assert all(r["coverage"] == 1 for r in got)


def test_words():
    words, at = decontam.words_of(pa.array(["", "Äb日本c 1!x", None, "日", "äb"]))
    assert np.diff(at).tolist() == [0, 6, 0, 1, 1]  # äb 日 本 c 1 x
    assert words[0] == words[7] and words[1] == words[6]


def test_spaced_texts_have_the_same_words_as_before():
    rnd = random.Random(4)
    plain = np.full(256, 0x20, np.uint8)
    plain[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
    for _ in range(200):
        column = pa.array(["".join(rnd.choices("abÉñ ß.,\n'19", k=rnd.randint(0, 30))) for _ in range(5)])
        lower, rows = decontam.utf8(decontam.pc.utf8_lower(column))
        start, end, row = minhash.word_bounds(plain[lower], rows)
        got, at = decontam.words_of(column)
        assert got.tolist() == minhash.word_hashes(plain[lower], start, end).tolist()
        assert np.diff(at).tolist() == np.bincount(row, minlength=5).tolist()
