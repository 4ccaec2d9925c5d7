r"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters (lower-cased), digits and all code points
beyond ASCII.  A text's blocks of size L are its words from k * L on, 2 * L of
them, for every k: any L successive words lie whole in a block.  A template of
n words is sought in blocks of the smallest L of 16, 32, 64 ... with L >= n.  A
block meets a template if it holds ``SHARE`` of the template's distinct words
or more.

The join follows the filters of prefix-based set-similarity joins:

* only words of templates can be common, so a block is its set of such words;
* length: a block with fewer of them than the least required overlap of the
  templates of its size is dropped in the map that reads the texts;
* words are ordered by their number of blocks over the whole input, rarest
  first; two sets with an overlap of a or more have a common word in their
  first |set| - a + 1 words, so only these prefixes are joined;
* position: a pair is dropped if the words behind the common one can't make up
  the required overlap;
* what is left is confirmed on the whole sets.

Templates are arguments of the operator, so their words, which go to all tasks,
don't grow with the texts.  Base labels come from exact phrases.

Defined results: null and empty texts have no words, no labels and a score of
0; rows that share an id, or have none, are scanned each for itself; long texts
are scanned whole, without a cap on blocks; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import offsets_of, pieces, ragged, staged, table, utf8
from scorewise.llm.minhash import word_hashes

#: Part of a template's distinct words that a block must hold.
SHARE = 0.9
LEAST_BLOCK = 16
#: Phrases and labels of the exact scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wording of public license notices, and their labels.
TEMPLATES = (
    ("mit", "Distributed under the terms of the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
    ),
    ("gpl-3", "Licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words_of(text: str) -> list[str]:
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]  # distinct
    size: int  # L of its blocks
    overlap: int  # words that a block must hold


class Vocabulary:
    """The words of templates and phrases, found in bytes by a hash and confirmed byte by byte."""

    def __init__(self, templates: tuple, phrases: tuple, share: float) -> None:
        listed = [words_of(t) for _, t in templates]
        spoken = [words_of(p) for p, _ in phrases]
        self.words = sorted({w for ws in listed + spoken for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        raw = [w.encode() for w in self.words]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.start = offsets_of(self.size)[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        hashes = word_hashes(self.bytes, self.start, self.start + self.size)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = []
        for (label, _), ws in zip(templates, listed):
            block = LEAST_BLOCK
            while block < len(ws):
                block *= 2
            distinct = tuple(sorted({number[w] for w in ws}))
            self.templates.append(Template(label, distinct, block, math.ceil(share * len(distinct) - 1e-9)))
        self.phrases = [([number[w] for w in ws], label) for (_, label), ws in zip(phrases, spoken)]
        self.blocks = {}  # L -> which words count, the least overlap that is required
        for t in self.templates:
            if t.words:
                inside, least = self.blocks.get(t.size, (np.zeros(len(self.words) + 1, bool), t.overlap))
                inside[list(t.words)] = True
                self.blocks[t.size] = inside, min(least, t.overlap)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word between ``start`` and ``end``; the number of words for any other."""
        out = np.full(len(start), len(self.words), np.int64)
        if not len(start) or not len(self.words):
            return out
        h = word_hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        guess = self.order[at]
        hit = np.flatnonzero((self.hashes[at] == h) & (self.size[guess] == end - start))
        if len(hit):
            n, guess = self.size[guess[hit]], guess[hit]
            same = data[ragged(start[hit], n)] == self.bytes[ragged(self.start[guess], n)]
            whole = np.logical_and.reduceat(same, offsets_of(n)[:-1])
            out[hit[whole]] = guess[whole]
        return out


def _bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets of each row's words."""
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])))
    end = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False))) + 1
    return start, end, np.searchsorted(start, rows)


def _blocks(number: np.ndarray, at: np.ndarray, row: np.ndarray, known: Vocabulary) -> list[list[dict]]:
    """Per row, the blocks that could meet a template: size, number k, and the distinct template words."""
    found: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    for size, (inside, least) in known.blocks.items():
        hit = np.flatnonzero(inside[number])
        if not len(hit):
            continue
        own = row[hit]
        k = (hit - at[own]) // size
        base = offsets_of((np.diff(at) + size - 1) // size)  # blocks of all rows, numbered through
        block = np.concatenate([base[own] + k, (base[own] + k - 1)[k > 0]])
        word = np.concatenate([number[hit], number[hit][k > 0]])
        enough = np.bincount(block, minlength=base[-1]) >= least
        keep = enough[block]
        keys = np.unique(block[keep] * (len(known.words) + 1) + word[keep])
        block, word = np.divmod(keys, len(known.words) + 1)
        edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= least:
                r = int(np.searchsorted(base, block[a], side="right")) - 1
                found[r].append({"size": size, "k": int(block[a] - base[r]), "words": word[a:b].tolist()})
    return found


_FOUND = pa.list_(pa.struct([("size", pa.int32()), ("k", pa.int64()), ("words", pa.list_(pa.int32()))]))


def scanned(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(row, id, n_words, n_base, first_word, last_word, base, blocks) of each row of ``docs`` (id, text); one map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in pieces(whole, "text"):
                data, rows = utf8(part.column("text"))
                data = _LOWER[data]
                start, end, at = _bounds(data, rows)
                n = part.num_rows
                row = np.repeat(np.arange(n), np.diff(at))
                number = known.find(data, start, end)
                places, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[list[str]] = [[] for _ in range(n)]
                for phrase, label in known.phrases:
                    many = len(number) - len(phrase) + 1
                    if many <= 0:
                        continue
                    hit = row[:many] == row[len(phrase) - 1 :]
                    for j, w in enumerate(phrase):
                        hit &= number[j : j + many] == w
                    hit = np.flatnonzero(hit)
                    own, place = row[hit], hit - at[row[hit]]
                    places += np.bincount(own, minlength=n)
                    np.minimum.at(first, own, place)
                    np.maximum.at(last, own, place)
                    for r in np.unique(own).tolist():
                        labels[r].append(label)
                none = places == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(count, count + n)), part.column("id"), pa.array(np.diff(at)), pa.array(places), pa.array(first, mask=none),
                        pa.array(last, mask=none), pa.array(labels, pa.list_(pa.string())), pa.array(_blocks(number, at, row, known), _FOUND),
                    ],
                    ["row", "id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )
                count += n

    kind = dict(docs.dtypes)["id"]
    fields = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<size:int,k:long,words:array<int>>>"
    return docs.select("id", "text").mapInArrow(run, f"row long, id {kind}, {fields}")


def matches(found: DataFrame, known: Vocabulary) -> DataFrame:
    """(row, label, template, first, last, share): blocks, from word ``first`` to ``last``, that meet a template."""
    spark = found.sparkSession
    blocks = found.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.k", "b.words")
    counts = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # one row per word of the templates
    order = sorted(range(len(known.words)), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    sides = []
    for i, t in enumerate(known.templates):
        ranks = sorted(rank[w] for w in t.words)
        sides += [(i, t.label, t.size, t.overlap, len(ranks), j, r, ranks) for j, r in enumerate(ranks[: len(ranks) - t.overlap + 1])]
    schema = "template int, label string, size int, overlap int, t_words int, t_pos int, rank int, t_ranks array<int>"
    side = F.broadcast(spark.createDataFrame(sides, schema))  # as long as the templates, which are arguments
    ranks = F.array(*(F.lit(rank[w]) for w in range(len(known.words))))
    sets = blocks.withColumn("ranks", F.array_sort(F.transform("words", lambda w: F.get(ranks, w)))).drop("words")
    least = F.coalesce(*(F.when(F.col("size") == size, F.lit(need)) for size, (_, need) in known.blocks.items())) if known.blocks else F.lit(1)
    sets = sets.withColumn("b_words", F.size("ranks"))
    prefix = F.slice("ranks", F.lit(1), F.greatest(F.col("b_words") - least + 1, F.lit(0)))
    posted = sets.select("*", F.posexplode(prefix).alias("b_pos", "rank"))
    pairs = posted.join(side, ["size", "rank"])
    pairs = pairs.filter("b_words >= overlap")
    pairs = pairs.filter(F.least(F.col("b_words") - F.col("b_pos"), F.col("t_words") - F.col("t_pos")) >= F.col("overlap"))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("ranks", "t_ranks"))).filter("common >= overlap")
    # a pair may have several common words in its prefixes
    one = pairs.groupBy("row", "size", "k", "template").agg(*(F.first(c).alias(c) for c in ("label", "common", "t_words")))
    first = F.col("k") * F.col("size")
    return one.select("row", "label", "template", first.alias("first"), (first + 2 * F.col("size") - 1).alias("last"), (F.col("common") / F.col("t_words")).alias("share"))


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (id, text) its words, places and labels; and the blocks that meet a template (see ``matches``)."""
    known = Vocabulary(templates, phrases, share)
    found = staged(scanned(docs, known), "scanned")
    met = staged(matches(found, known), "blocks")
    added = met.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("best"))
    rows = found.drop("blocks").join(added, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    out = rows.select(
        "row", "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
    return out, met


def op11_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out, _ = license_scan(docs)
    return out.drop("row").withColumnRenamed("id", "doc_id")


def _sql() -> str:
    known = Vocabulary(TEMPLATES, PHRASES, SHARE)
    words = ", ".join(f"({i}, '{t.label}', {t.size}, {t.overlap}, {len(t.words)}, '{known.words[w]}')" for i, t in enumerate(known.templates) for w in t.words)
    spoken = [([known.words[w] for w in phrase], label) for phrase, label in known.phrases]
    longest = max(len(ws) for ws, _ in spoken)
    ahead = "".join(f", lead(word, {j}) OVER (PARTITION BY doc_id ORDER BY place) AS word{j}" for j in range(1, longest))
    tests = " UNION ALL ".join(
        f"SELECT doc_id, place, '{label}' AS label FROM ahead WHERE word = '{ws[0]}'" + "".join(f" AND word{j} = '{w}'" for j, w in enumerate(ws) if j) for ws, label in spoken
    )
    return rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), words AS (SELECT doc_id, unnest(words) AS word, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS place FROM split
), ahead AS (SELECT *{ahead} FROM words
), places AS ({tests}
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id
), templates(template, label, size, overlap, t_words, word) AS (VALUES {words}
), near AS (
  SELECT DISTINCT w.doc_id, t.*, w.place // t.size - shift AS k FROM words w JOIN templates t ON t.word = w.word, (VALUES (0), (1)) AS s(shift)
  WHERE w.place // t.size >= shift
), met AS (
  SELECT doc_id, label, count(*) / any_value(t_words) AS share FROM near GROUP BY doc_id, template, label, k HAVING count(*) >= any_value(overlap)
), labelled AS (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places
), every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY doc_id
), best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(e.labels, '') AS labels, CASE WHEN b.doc_id IS NOT NULL THEN 1.0 ELSE coalesce(t.share, 0.0) END AS score
FROM split s LEFT JOIN base b ON b.doc_id = s.doc_id LEFT JOIN every e ON e.doc_id = s.doc_id LEFT JOIN best t ON t.doc_id = s.doc_id
"""


OP11_SQL = _sql()
