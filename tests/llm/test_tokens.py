"""Encoding, decoding and token files against the libraries."""

from __future__ import annotations

import base64
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest

from scorewise.llm import bpe, idcodec, pretoken

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_those_of_the_pattern():
    regex = pytest.importorskip("regex")
    rnd = random.Random(5)
    parts = ["a", "É", "'", "'s", "'re", "'ll", "'x", " ", "  ", "\n", "\t", "1", "٣", "!", "日本", " ", "😀", "\r\n", "́"]
    for _ in range(300):
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        rows = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds, before = pretoken.piece_bounds(data, rows)
        for i, t in enumerate(texts):
            got = [data[a:b].tobytes().decode() for a, b in zip(bounds[before[i] : before[i + 1]], bounds[before[i] + 1 : before[i + 1] + 1])]
            assert got == regex.findall(public_tokenizers.PATTERN, t)


def test_scan_blocks_agree_with_single_steps():
    rnd = np.random.default_rng(1)
    symbols = rnd.integers(0, 8, 3000).astype(np.uint8)
    symbols[::97] += 8
    state, want = pretoken.CLOSED, []
    for s in symbols.tolist():
        want.append(state)
        state = pretoken._step(s % 8, pretoken.CLOSED if s >= 8 else state)[0]
    for width in (2, 64, 512, 5000):
        assert pretoken.scan_states(symbols, width).tolist() == want


def test_encode_decode(odd_docs, library):
    encoded = bpe.encode(odd_docs, MULTI)
    for row in bpe.decode(encoded, MULTI).join(odd_docs.select("doc_id", "text").filter("doc_id <> 17"), "doc_id").collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["bytes"]) == (row["text"] or "").encode()
    assert encoded.count() == odd_docs.count()
    for row in bpe.decode(encoded, MULTI, span=(10, 40)).filter("doc_id = 1").collect():
        whole = odd_docs.filter("doc_id = 1").first()["text"].encode()
        assert whole.find(bytes(row["bytes"])) >= 10 and len(row["bytes"]) > 20


def test_empty_tables(no_docs):
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, MULTI), MULTI)).count() == 0
    assert idcodec.encode_sorted(no_docs, JSON).count() == 0


def test_long_pieces_merge_alike(library):
    known = bpe.ranks(MULTI)
    rnd = random.Random(2)
    for _ in range(200):
        word = "".join(rnd.choices("abet é", k=rnd.randint(1, 40))).encode()
        side = np.frombuffer(known.merge_all([word])[0], "<i4").tolist()
        assert side == known.merge_long(word)


def test_code_lengths_are_bounded_and_complete():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 5000):
        counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        bits = idcodec.code_lengths(counts)
        assert bits.max() <= idcodec.MAX_BITS and bits.min() >= 1
        assert n == 1 or abs((0.5**bits).sum() - 1) < 1e-9
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert idcodec.code_lengths(np.array(fib)).max() == idcodec.MAX_BITS


def test_pack_unpack():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 10_000), 3000).astype(np.int64)
    seen, counts = np.unique(ids, return_counts=True)
    code = idcodec.Code(seen, idcodec.code_lengths(counts))
    runs = [ids[:1], ids[:700], ids, ids[5:261]]
    packed = [code.pack(r) for r in runs]
    back = code.unpack([p for p, _ in packed], [c for _, c in packed], [len(r) for r in runs])
    assert all((a == b).all() for a, b in zip(runs, back))


def test_token_files(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    from scorewise.llm.common import staged

    path = f"{tmp_path}/{uuid.uuid4().hex}"
    idcodec.write_blocks(staged(idcodec.encode_sorted(odd_docs, JSON), "t"), path)
    got = idcodec.read_blocks(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x or 0))
    want = sorted(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in odd_docs.collect())
    assert sorted(list(r["ids"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])
    assert zlib.crc32(b"") == 0
