from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scorewise.llm import licenses, repair, trie, turns

TURNS = "conv_id long, turn long, role string, text string, place int, depth string"


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Null ids, turns, roles and texts; equal turns; a long conversation; shared first turns; clashing names."""
    rnd = random.Random(8)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (7, None, "user", "x."), (7, 2, "assistant", " \t"), (7, 2, "assistant", "y"), (7, 2, "assistant", "y"), (8, 1, "", "z.")]
    rows += [(900, k, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b?", "c", "", "d!"])) for k in range(60)]
    for c in range(20, 60):
        said = "Same." if c % 3 else f"Own {c}."
        rows += [(c, k, ["user", "assistant"][k % 2], said + str(k // 3) + rnd.choice([".", "!"])) for k in range(rnd.randint(1, 12))]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], TURNS)


def order_key(row):
    return (row["turn"] is not None, row["turn"] or 0, row["role"] is not None, row["role"] or "", row["text"] is not None, row["text"] or "")


def test_places(spark, odd_turns):
    by = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    got = turns.numbered(odd_turns, "conv_id", by, ["conv_id", "turn", "role", "text"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, groups.values())) == odd_turns.count()
    for rows in groups.values():
        rows.sort(key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(len(rows)))
        assert [order_key(r) for r in rows] == sorted(order_key(r) for r in rows)


def cheapest_by_search(kinds: str) -> tuple[int, str]:
    """The least (cost, audit) by trying edits one by one from every place of the pattern, cheapest first."""
    import heapq

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, i = heapq.heappop(heap)
        if i == len(kinds) and at in (0, 3):
            return cost, audit
        if (at, i) in done:
            continue
        done.add((at, i))
        for role, steps in repair.STEPS.items():
            for p, q in steps:
                if p != at:
                    continue
                if role != "s":
                    heapq.heappush(heap, (cost + 5, audit + "I", q, i))
                if i < len(kinds) and kinds[i] != "x":
                    extra = 5 if kinds[i].isupper() else 0
                    if kinds[i].lower() == role:
                        heapq.heappush(heap, (cost + extra, audit + "K", q, i + 1))
                    if role != "s":
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", q, i + 1))
        if i < len(kinds):
            heapq.heappush(heap, (cost + 2, audit + "D", at, i + 1))


def test_chart_against_search():
    for n in range(4):
        for kinds in itertools.product("suaoSUAOx", repeat=n):
            cell = repair.parsed("".join(kinds)) if n else repair.insertions()
            assert min(cell[0, 0], cell[0, 3]) == cheapest_by_search("".join(kinds))
    rnd = random.Random(4)
    for _ in range(60):
        kinds = "".join(rnd.choices("uaUAsxo", k=rnd.randint(4, 11)))
        whole = repair.parsed(kinds)
        assert whole == repair.chart([repair.leaf(k) for k in kinds])
        assert min(whole[0, 0], whole[0, 3]) == cheapest_by_search(kinds)


def repaired_by_hand(rows: list[dict]) -> dict:
    """The contract of op12 for one conversation's rows after damage, in order."""
    seen, kinds, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for i, r in enumerate(rows):
        body, role = r["text"].rstrip(" \t\n\x0b\x0c\r"), r["role"][:1]
        kind = role if role and role in "sua" else "o"
        if not body:
            n["blank"], kind = n["blank"] + 1, "x"
        elif (r["role"], r["text"]) in seen:
            n["duplicate"], kind = n["duplicate"] + 1, "x"
        elif body[-1] not in ".!?":
            n["truncated"], kind = n["truncated"] + 1, kind.upper()
        seen.add((r["role"], r["text"]))
        kinds += kind
        n["illegal"] += bool(i) and rows[i - 1]["role"][:1] + role not in ("su", "ua", "au")
    known = {r["turn"] for r in rows if r["turn"] is not None}
    cost, audit = cheapest_by_search(kinds)
    lines, at, left = [], 0, iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else {"role": "", "text": ""}
        if edit == "D":
            continue
        if edit == "K" and at == 0 and row["role"][:1] == "s":
            at = 1
        else:
            at = 3 if at == 2 else 2
        lines.append((row["role"] if edit == "K" else {2: "user", 3: "assistant"}[at]) + ":" + row["text"])
    return n | {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


@pytest.mark.parametrize("span", [2, 8])
def test_repair_against_hand(spark, odd_turns, span):
    plain = [r.asDict() for r in odd_turns.collect()]
    after = []
    for r in plain:
        r = {k: " " if r[k] is None else r[k] for k in ("role", "text")} | {"conv_id": r["conv_id"], "turn": r["turn"]}
        name = f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            r["text"] = ""
        if hit == 2:
            r["text"] = r["text"].translate({ord(c): None for c in ".!?"})
        if hit == 4:
            r["role"] = "user"
        after += [r] * (2 if hit == 3 else 1)
    each, turns_after = repair.repair(repair.damaged(odd_turns), span)
    got = {r["conv_id"]: r.asDict() for r in each.collect()}
    hashes = {r["conv_id"]: r["sha256"] for r in repair.digests(turns_after).collect()}
    assert set(got) == {r["conv_id"] for r in after}
    for conv, found in got.items():
        wanted = repaired_by_hand(sorted((r for r in after if r["conv_id"] == conv), key=order_key))
        found["repaired_sha256"] = hashes.get(conv, hashlib.sha256(b"").hexdigest())
        del found["conv_id"]
        assert found == wanted, conv


def trie_by_hand(rows: list[dict]) -> dict:
    convs = {}
    for r in sorted((r for r in rows if r["conv_id"] is not None), key=lambda r: order_key(r | {"role": r["role"] or "", "text": r["text"] or ""})):
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = convs.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = {}
    for key, found in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = sorted(c for c, end in found if end)
        kids = [k for k in below if len(k) == len(key) + 1]
        out[min(found)[0], len(key)] = (
            min(nodes[key[:-1]])[0] if key else None, len(found), len(kids), sum(not any(len(k) == len(b) + 1 and k[: len(b)] == b for k in nodes) for b in below),
            sum((len(nodes[b]) - 1) * len(b[-1][1].encode()) for b in below if b), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize(("block", "task_nodes"), [(1024, 20_000), (3, 12)])
def test_trie_against_hand(spark, odd_turns, block, task_nodes):
    rows = trie.prefix_trie(odd_turns, block, task_nodes).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    assert got == trie_by_hand([r.asDict() for r in odd_turns.collect()])


def test_split_component():
    import numpy as np

    rnd = random.Random(2)
    for n in [1, 2, 3, 10, 200]:
        for reach in (1, 4, n):  # chains, trees, stars
            parents = [-1] + [rnd.randint(max(0, i - reach), i - 1) if reach < n else 0 for i in range(1, n)]
            values = np.array([[rnd.randint(0, 9), 1] for _ in range(n)])
            wanted = values.copy()
            for i in range(n - 1, 0, -1):
                wanted[parents[i]] += wanted[i]
            assert (trie.split_component(parents, values) == wanted).all()


def test_empty_tables(spark, odd_turns):
    none = odd_turns.limit(0)
    each, after = repair.repair(repair.damaged(none))
    assert each.collect() == [] and after.collect() == [] and repair.digests(after).collect() == []
    assert trie.prefix_trie(none).collect() == []
    out, met = licenses.license_scan(none.select(F.col("conv_id").alias("id"), "text"))
    assert out.collect() == [] and met.collect() == []


def blocks_by_hand(text: str, templates, share: float):
    ws = licenses.words_of(text or "")
    found = set()
    for i, (label, wording) in enumerate(templates):
        listed = licenses.words_of(wording)
        size = licenses.LEAST_BLOCK
        while size < len(listed):
            size *= 2
        for k in range(-(-len(ws) // size)):
            common = len(set(ws[k * size : k * size + 2 * size]) & set(listed))
            if common >= share * len(set(listed)) - 1e-9:
                found.add((i, label, k * size, k * size + 2 * size - 1, common / len(set(listed))))
    return ws, found


def test_licenses_against_hand(spark, odd_docs):
    rnd = random.Random(6)
    notices = [t for _, t in licenses.TEMPLATES] + ["Released UNDER the MIT license.", "cc by nc by nc CC-BY-NC", "Apache licence", "apache license, version 2"]
    filler = " ".join(notices).split()
    texts = [None, "", " . ", "日本 cc by nc é", *notices]
    for _ in range(40):
        words = rnd.choices(filler, k=rnd.randint(1, 90))
        some = rnd.choice(notices).split()
        rnd.shuffle(some) if rnd.random() < 0.3 else None
        at = rnd.randint(0, len(words))
        texts.append(" ".join(words[:at] + some[rnd.randint(0, 2) :] + words[at:]))
    texts.append(" ".join(rnd.choices(filler, k=20_000)))
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "id long, text string, row int").repartition(3)
    docs = docs.unionByName(odd_docs.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("row")))
    wanted = []
    for share in (0.9, 0.7):
        out, met = licenses.license_scan(docs, share=share)
        got, blocks = out.collect(), {}
        for r in met.collect():
            blocks.setdefault(r["row"], set()).add((r["template"], r["label"], r["first"], r["last"], r["share"]))
        found = sorted(((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], sorted(blocks.get(r["row"], set()))) for r in got), key=repr)
        wanted = []
        for d in docs.collect():
            ws, near = blocks_by_hand(d["text"], licenses.TEMPLATES, share)
            places, base = [], set()
            for phrase, label in licenses.PHRASES:
                p = phrase.split()
                hits = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
                places += hits
                base |= {label} if hits else set()
            labels = base | {x[1] for x in near}
            score = 1.0 if base else max((x[4] for x in near), default=0.0)
            wanted.append((d["id"], len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(near)))
        assert found == sorted(wanted, key=repr)


def test_piece_table(monkeypatch):
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from scorewise.llm import idcodec

    rnd = random.Random(12)
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = [" the", "the", "'s", "\n", "  ", "\t", " don't", " ", "　", "日本", "é", " É", "123", " 9", "!?", " -", "x" * 70, "\x1c", "\u0085", "<|", "|>"]
    texts = [None, "", " ", "\n\n x", "a  b"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(300)]
    column = pa.array(texts, pa.string())
    for slots, bits in ((1 << 12, 64), (16, 64), (1 << 12, 3)):
        known = idcodec.Pieces(path, slots)
        true = idcodec.slice_hashes
        monkeypatch.setattr(idcodec, "slice_hashes", lambda d, b: true(d, b) >> np.uint64(64 - bits))
        for _ in range(2):
            ids, at = known.batch_ids(column)
            for i, text in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == known.library.encode(text or "", add_special_tokens=False).ids
        monkeypatch.setattr(idcodec, "slice_hashes", true)


def test_round_trip_in_one_map(spark, odd_docs):
    import public_tokenizers

    from scorewise.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    apart = bpe.digests(bpe.decode(bpe.encode(odd_docs, path), path)).collect()
    assert sorted(apart, key=repr) == sorted(bpe.round_trip(odd_docs, path).collect(), key=repr)
    named = odd_docs.select(F.col("doc_id").alias("text"), F.col("text").alias("body"))
    got = bpe.round_trip(named, path, "text", "body").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((tuple(r) for r in apart), key=repr)
