"""Benchmark decontamination by greedy string tiling.

Texts become sequences of words (lower case; ASCII but letters and digits, and
Unicode punctuation and spaces, separate).  In scripts that don't put spaces
between words (``UNSPACED``) each code point is a word of its own.
Karp-Rabin hashes of ``MIN_TILE`` successive words seed the comparison: a
document meets a benchmark item only if they share a seed.  Each such pair is
tiled: seeds are extended to maximal matches, the longest match of words that
no tile covers yet is marked, and this repeats until no match of MIN_TILE words
is left.  Tiles never overlap on either side but may stand in any order, so
passages whose parts were moved are found too.  An item is in a document if
its tiles cover at least ``share`` of its words.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text,
whose size is checked first; a larger benchmark is worked through block by
block.  The documents are one map per block and are never shuffled.

Defined results: null and empty texts contain nothing; items of fewer words
than MIN_TILE hold no evidence and match nothing; items with equal texts are
all reported; rows that share an id, or have none, are compared each for
itself; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm import minhash
from scorewise.llm.common import offsets_of, pieces, table, utf8
from scorewise.llm.pretoken import WHITE_SPACE

MIN_TILE = 5
SHARE = 0.5
BLOCK_BYTES = 16_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Code points [from, to] of scripts without spaces between words.
UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),  # Thai to Myanmar, Khmer, Tai, Balinese
    (0x2E80, 0x2FDF), (0x3000, 0x312F), (0x3190, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF),  # Han, kana, Bopomofo, Yi
    (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
SEPARATOR, PART, ALONE = range(3)


@functools.cache
def _kinds() -> np.ndarray:
    """Whether a code point separates words, is a part of one or is one."""
    kinds = np.full(sys.maxunicode + 1, PART, np.uint8)
    for lo, hi in UNSPACED:
        kinds[lo : hi + 1] = ALONE
    for cp in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] in "PZ":
            kinds[cp] = SEPARATOR
    kinds[[*WHITE_SPACE, 0x200B, 0xFEFF]] = SEPARATOR
    kinds[:128] = SEPARATOR
    kinds[[*range(48, 58), *range(97, 123)]] = PART
    return kinds


def _bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of UTF-8 rows, and each word's row."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _kinds()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    first = np.zeros(len(at), bool)
    first[np.searchsorted(at, rows[:-1][np.diff(rows) > 0])] = True
    before = np.append(np.uint8(SEPARATOR), kind[:-1])[: len(kind)]
    starts = (kind != SEPARATOR) & (first | (before != PART) | (kind == ALONE))
    ends = (kind != SEPARATOR) & np.append((starts | (kind == SEPARATOR))[1:], True)[: len(kind)]
    start = at[starts]
    return start, np.append(at, len(data))[np.flatnonzero(ends) + 1], np.searchsorted(rows, start, side="right") - 1


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, and the offsets of each row's."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, rows = utf8(pc.utf8_lower(column))
    start, end, row = _bounds(data, rows)
    return minhash.word_hashes(data, start, end), offsets_of(np.bincount(row, minlength=len(rows) - 1))


def karp_rabin(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    return out


def tiles(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (place in doc, place in item, words).

    ``seeds``: places in doc whose window of ``size`` words may also be in item.
    """
    places = defaultdict(list)
    for j, h in enumerate(karp_rabin(item, size).tolist()):
        places[h].append(j)
    windows = karp_rabin(doc, size)
    by_diagonal = defaultdict(list)
    for i in seeds.tolist():
        for j in places.get(int(windows[i]), ()):
            by_diagonal[i - j].append(i)
    queue: list[tuple[int, int, int]] = []
    for d, hits in by_diagonal.items():
        begin = before = hits[0]
        for i in [*hits[1:], None]:
            if i is None or i > before + 1:
                queue.append((-(before - begin + size), begin, begin - d))
                begin = i
            before = i
    heapq.heapify(queue)
    doc_open, item_open = np.ones(len(doc), bool), np.ones(len(item), bool)
    found = []
    while queue:
        length, i, j = heapq.heappop(queue)
        length = -length
        free = doc_open[i : i + length] & item_open[j : j + length]
        if free.all():
            found.append((i, j, length))
            doc_open[i : i + length] = False
            item_open[j : j + length] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(queue, (-(b - a), i + a, j + a))
    return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, size: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, spans): pairs whose tiles cover ``share`` of the item.

    ``spans`` lists the tiles as words [from, to) of the document.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {id_type}, item_id long, coverage double, n_tiles long, longest long, spans array<struct<at: long, to: long>>"
    found = None
    for block in _blocks(benchmark):
        part = _match_block(rows, block, share, size, schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _match_block(rows: DataFrame, block: list[tuple[int, str]], share: float, size: int, schema: str) -> DataFrame:
    words, offsets = words_of(pa.array([t for _, t in block], pa.string()))
    grams, owners = [], []
    for k in range(len(block)):
        got = np.unique(karp_rabin(words[offsets[k] : offsets[k + 1]], size))
        grams.append(got)
        owners.append(np.full(len(got), k, np.int64))
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    item_ids = np.array([i if i is not None else -1 for i, _ in block], np.int64)
    no_id = np.array([i is None for i, _ in block])
    # seeds are first looked up by their low bits: a bitmap of fixed size
    seen = np.zeros(1 << 22, bool)
    seen[(gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    packed = np.packbits(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(packed).astype(bool)
        for whole in batches:
            for part in pieces(whole, "text"):
                doc_words, at = words_of(part.column("text"))
                windows = karp_rabin(doc_words, size)
                maybe = np.flatnonzero(bitmap[(windows & np.uint64((1 << 22) - 1)).astype(np.int64)])
                lo = np.searchsorted(gram, windows[maybe], side="left")
                hi = np.searchsorted(gram, windows[maybe], side="right")
                real = hi > lo
                maybe, lo, hi = maybe[real], lo[real], hi[real]
                row = np.searchsorted(at, maybe, side="right") - 1
                inside = maybe + size <= at[row + 1]
                maybe, lo, hi, row = maybe[inside], lo[inside], hi[inside], row[inside]
                seeds: dict[tuple[int, int], list[int]] = defaultdict(list)
                for i, a, b, r in zip(maybe.tolist(), lo.tolist(), hi.tolist(), row.tolist()):
                    for k in owner[a:b].tolist():
                        seeds[r, k].append(i)
                out: list[tuple] = []
                for (r, k), places in seeds.items():
                    item = words[offsets[k] : offsets[k + 1]]
                    span = np.array(places)
                    # words that any seed covers bound what tiles can cover
                    if len(item) == 0 or len(places) + (size - 1) * (1 + int((np.diff(span) > 1).sum())) < share * len(item):
                        continue
                    got = tiles(doc_words[at[r] : at[r + 1]], item, span - at[r], size)
                    covered = sum(n for _, _, n in got)
                    if covered >= share * len(item):
                        out.append((r, k, covered / len(item), len(got), max(n for _, _, n in got), [{"at": i, "to": i + n} for i, _, n in sorted(got)]))
                if out:
                    r, k = np.array([x[0] for x in out]), np.array([x[1] for x in out])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(r)), pa.array(item_ids[k], mask=no_id[k]), pa.array([x[2] for x in out], pa.float64()),
                            pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64()),
                            pa.array([x[5] for x in out], pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))),
                        ],
                        ["doc_id", "item_id", "coverage", "n_tiles", "longest", "spans"],
                    )

    return rows.mapInArrow(run, schema)


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): benchmark items found in documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
