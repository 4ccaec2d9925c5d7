"""Token files of texts that hold the tokenizer file's added token, against the unmodified library."""

from __future__ import annotations

import random
import uuid

import public_tokenizers

from scorewise.llm import idcodec
from scorewise.llm.common import staged

JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def test_texts_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    parts = [END, END, "<|endoftext|", "|>", "a", " ", "  ", "\n", "don't", "É日", "12", "😀"]
    texts = ["a " + END + "b", END, END + END, " " + END + " ", None, "", "plain words", *("".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    idcodec.write_blocks(staged(idcodec.encode_sorted(docs, JSON), "t"), path)
    got = idcodec.read_blocks(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(JSON)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [64, 220, 50256, 65, 0]
    assert [list(r["ids"]) for r in got] == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])
