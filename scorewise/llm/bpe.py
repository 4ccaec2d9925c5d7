"""Byte-level BPE encoding and decoding by a rank file.

``encode`` cuts each whole text into pieces (pretoken.py) and merges the bytes
of each piece by rank, lowest first and leftmost among equals.  The ids of a
piece are kept in a bounded cache of each Python worker, so that merging runs
on new pieces only, all new pieces of a batch side by side.  Each id keeps the
byte offset at which it starts, so ``decode`` can return any span.

Null and empty texts have no ids.  Rows are independent: equal rows, null ids
and extra columns change nothing.  Work is one map over the rows, no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewise.llm.common import free_name, list_column, list_pieces, mix64, offsets_of, pieces, ragged, utf8
from scorewise.llm.pretoken import piece_bounds

#: Pieces kept by each worker's cache, and the longest piece (bytes) merged side by side.
CACHE_PIECES = 150_000
SIDE_BY_SIDE = 48
NONE = np.int64(2**40)


class Ranks:
    """A rank file: tokens' bytes, and the token that each pair of tokens merges into."""

    def __init__(self, path: str) -> None:
        tokens: list[bytes] = []
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], NONE), np.append(values[order], NONE)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = offsets_of(self.sizes)[:-1]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a linked list of tokens and a heap of (rank, place) pairs."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        get = self.pairs.get
        heap = []
        for i in range(len(ids) - 1):
            rank = get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                new = get(rank << 20 | ids[k])
                if new is not None:
                    heapq.heappush(heap, (new, i))
            h = before[i]
            if h >= 0:
                new = get(ids[h] << 20 | rank)
                if new is not None:
                    heapq.heappush(heap, (new, h))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of many pieces: in each round every open piece makes its best merge."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = np.array(self.merge_long(w), "<i4").tobytes()
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short], np.int64)
        data = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        ids = self.single[data]
        word = np.repeat(np.arange(len(short)), sizes)
        place = np.array(short)
        while len(ids):
            rank = np.full(len(ids), NONE)
            if len(ids) > 1:
                inside = word[1:] == word[:-1]
                rank[:-1][inside] = self.pair_ranks(ids[:-1][inside], ids[1:][inside])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(ids)))
            done = best == NONE
            raw = ids.astype("<i4").tobytes()
            first, size = begin[done] * 4, count[done] * 4
            for b, e, w in zip(first.tolist(), (first + size).tolist(), place[word[begin[done]]].tolist()):
                out[w] = raw[b:e]
            live = np.repeat(~done, count)
            target = np.repeat(best, count)
            hit = np.flatnonzero(live & (rank == target))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])] if len(hit) else hit
            ids[hit] = rank[hit]
            live[hit + 1] = False
            ids, word = ids[live], word[live]
        return out


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


class PieceCache:
    """Piece -> ids (little-endian 32-bit), bounded: two generations, the older one is dropped when the newer is full."""

    def __init__(self, merge, limit: int = CACHE_PIECES) -> None:
        self.merge, self.limit = merge, limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        got = list(map(young.get, words))
        missing = {w for w, x in zip(words, got) if x is None}
        if missing:
            new = []
            for w in missing:
                x = old.get(w)
                if x is None:
                    new.append(w)
                else:
                    young[w] = x
            if new:
                young.update(zip(new, self.merge(new)))
            got = list(map(young.__getitem__, words))
        counts = np.array(list(map(len, got)), np.int64) >> 2
        return np.frombuffer(b"".join(got), "<i4"), counts


@functools.cache
def _cache(path: str) -> PieceCache:
    return PieceCache(ranks(path).merge_all)


def batch_ids(column: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and the offsets of each row's ids."""
    data, rows = utf8(column)
    bounds, before = piece_bounds(data, rows)
    if len(bounds) == 1:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    raw = data.tobytes()
    _, where, which = np.unique(slice_hashes(data, bounds), return_index=True, return_inverse=True)
    words = [raw[a:b] for a, b in zip(bounds[where].tolist(), bounds[where + 1].tolist())]
    flat, counts = cache.ids(words)
    at = offsets_of(counts)[:-1]
    each = counts[which]
    return flat[ragged(at[which], each)], offsets_of(each)[before]


@functools.cache
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, and a random odd weight for each place in a piece."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    places = mix64(np.arange(1, SIDE_BY_SIDE + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return values, places | np.uint64(1)


def slice_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice between two bounds; long slices' hashes come from a digest."""
    values, weights = _weights()
    size = np.diff(bounds)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), size)
    weighed = values[data] * weights[np.minimum(place, SIDE_BY_SIDE)]
    out = mix64(np.add.reduceat(weighed, bounds[:-1]) + size.astype(np.uint64))
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        digest = hashlib.blake2b(data[bounds[i] : bounds[i + 1]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, rank_file: str) -> Batches:
    """(id, ids, starts) of (id, text)."""
    known, cache = ranks(rank_file), _cache(rank_file)
    for whole in batches:
        for part in pieces(whole, whole.schema.names[1]):
            ids, offsets = batch_ids(part.column(1), cache)
            sizes = known.sizes[ids]
            ends = offsets_of(sizes)
            starts = ends[:-1] - np.repeat(ends[offsets[:-1]], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([part.column(0), list_column(ids.astype(np.int32), offsets), list_column(starts.astype(np.int32), offsets)], [part.schema.names[0], "ids", "starts"])


def _decoded(batches: Batches, rank_file: str) -> Batches:
    """(id, ids, bytes) of (id, ids and more)."""
    known = ranks(rank_file)
    for batch in (part for whole in batches for part in list_pieces(whole, "ids")):
        column = batch.column("ids")
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = known.sizes[ids]
        data = known.bytes[ragged(known.at[ids], sizes)]
        ends = offsets_of(sizes)[offsets_of(counts)]
        raw = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), column, raw], [batch.schema.names[0], "ids", "bytes"])


def _digested(batches: Batches) -> Batches:
    """(id, n_tokens, ids_sha256, decoded_sha256) of (id, ids, bytes)."""
    for batch in (part for whole in batches for part in list_pieces(whole, "ids")):
        column = batch.column("ids")
        ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = (offsets_of(counts) * 4).tolist()
        hashed = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("bytes")]
        names = [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(hashed, pa.string()), pa.array(texts, pa.string())], names)


_IDS = T.ArrayType(T.IntegerType())
_DIGESTS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _schema(rows: DataFrame, id_col: str, more: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([rows.select(id_col).schema[0], *(T.StructField(n, t) for n, t in more)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.col(text_col).cast("string").alias(free_name("text", [id_col])))


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>): each id and the byte at which it starts."""

    def run(batches: Batches) -> Batches:
        return _encoded(batches, rank_file)

    return _texts(docs, id_col, text_col).mapInArrow(run, _schema(docs, id_col, [("ids", _IDS), ("starts", _IDS)]))


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", span: tuple[int, int] | None = None) -> DataFrame:
    """(id, ids, bytes binary): the text's bytes again, or only of the ids that start in ``span`` bytes."""
    rows = encoded.select(id_col, "ids", "starts")
    if span is not None:
        lo, hi = span
        inside = F.filter(F.arrays_zip("ids", "starts"), lambda x: (x["starts"] >= lo) & (x["starts"] < hi))
        rows = rows.select(id_col, inside.getField("ids").alias("ids"))

    def run(batches: Batches) -> Batches:
        return _decoded(batches, rank_file)

    return rows.select(id_col, "ids").mapInArrow(run, _schema(encoded, id_col, [("ids", _IDS), ("bytes", T.BinaryType())]))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(id_col, "ids", "bytes").mapInArrow(_digested, _schema(decoded, id_col, _DIGESTS))


def round_trip(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``digests(decode(encode(docs)))``, in one map: a task needs one Python worker, and no ids go through the JVM."""

    def run(batches: Batches) -> Batches:
        return _digested(_decoded(_encoded(batches, rank_file), rank_file))

    return _texts(docs, id_col, text_col).mapInArrow(run, _schema(docs, id_col, _DIGESTS))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scorewise.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path)
