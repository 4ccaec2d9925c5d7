"""Token ids as files of canonical length-limited Huffman codes.

``encode_sorted`` gives each document's ids (and an end id) in ascending order
of ids, cut into ranges; ``code_lengths`` turns the global counts of ids into
code lengths of at most ``MAX_BITS`` bits; ``write_blocks`` codes runs of whole
documents as independent blocks of bits.  A block carries, every ``STEP`` ids,
the bit at which the next id starts, so a table-driven decoder can begin at
any of these checkpoints; ``read_blocks`` decodes all checkpoints of a batch of
blocks side by side.

Files: ``<path>/lengths`` (id, count, bits) and ``<path>/blocks`` (first id
position, checkpoints, bits, and the documents' ids, starts and sizes), both
Parquet, written by Spark, so they can lie in any store that Spark reaches.

Ids are those of the library on the whole text: added tokens of the tokenizer
file are cut out of a text first and have their own ids.

Defined results: null and empty texts have the end id only; rows that share an
id, or have none (these come first), follow each other by text; an empty table
gives empty files.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewise.llm.bpe import slice_hashes
from scorewise.llm.common import list_column, list_pieces, offsets_of, pieces, ragged, release, scratch, staged, table, utf8
from scorewise.llm.pretoken import piece_bounds

MAX_BITS = 18
STEP = 256
BLOCK_IDS = 1 << 16
#: Slots of a worker's table of pieces; half of them are used at most, then it begins anew.
SLOTS = 1 << 22
#: Bytes of text that are worked on at a time.
TEXT_BYTES = 1_000_000


class Pieces:
    """Piece -> ids of the library, for whole arrays of pieces at once.

    A table with open addressing holds the pieces' 64-bit hashes; a hit is
    compared with the piece byte by byte.  Distinct pieces that aren't there yet
    go to the library in one text: it is put together so that the library cuts it
    where the pieces end, which is checked by the lengths of the ids' tokens.
    """

    def __init__(self, path: str, slots: int = SLOTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)  # one character stands for one byte
        self.slots, self.mask = slots, np.uint64(slots - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.n = self.n_ids = self.n_bytes = 0
        self.id_at, self.byte_at = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # of entry i: from place i to place i + 1
        narrow = len(self.token_bytes) <= 1 << 16
        self.ids, self.bytes = np.zeros(4096, np.uint16 if narrow else np.int32), np.zeros(4096, np.uint8)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (h & self.mask).astype(np.int64)
        out = self.entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            out[open_] = self.entry[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != h[open_])]
        return out

    def _add(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """New pieces: distinct hashes that aren't in the table."""
        ids, counts = self._encode([data[a : a + k].tobytes() for a, k in zip(begin.tolist(), size.tolist())])
        self.id_at = _grown(self.id_at, self.n + 1, self.n_ids + np.cumsum(counts))
        self.byte_at = _grown(self.byte_at, self.n + 1, self.n_bytes + np.cumsum(size))
        self.ids = _grown(self.ids, self.n_ids, ids)
        self.bytes = _grown(self.bytes, self.n_bytes, data[ragged(begin, size)])
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.n_ids, self.n_bytes = self.n + len(h), self.n_ids + len(ids), self.n_bytes + int(size.sum())
        slot = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            self.entry[slot[free]] = number[free]  # of several that want a slot, the last one has it
            mine = free[self.entry[slot[free]] == number[free]]
            self.keys[slot[mine]] = h[mine]
            left = left[self.entry[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces, and how many each has."""
        led, bare, alone = [], [], []
        for i, w in enumerate(words):
            if w[0] == 32 and len(w) > 1 and w[1] not in b" \t\n\x0b\x0c\r":
                led.append(i)
            elif w.isspace() or (w[0] >= 0xC2 and w.decode().isspace()):
                alone.append(i)
            else:
                bare.append(i)
        # a line feed before something else is a piece, and so is what a blank leads
        text = b"\n".join([words[i] for i in bare]) + b"".join([words[i] for i in led])
        found: list[np.ndarray | None] = [None] * len(words)
        if text:
            ids = self._library([text])[0]
            ends = np.cumsum(self.token_bytes[ids])
            sizes = np.array([len(words[i]) for i in bare + led], np.int64)
            apart = np.zeros(len(sizes), np.int64)
            apart[: max(0, len(bare) - 1)] = 1
            stop = np.cumsum(sizes + apart) - apart
            first, last = np.searchsorted(ends, stop - sizes, side="right"), np.searchsorted(ends, stop, side="left")
            if (ends[np.minimum(last, len(ends) - 1)] == stop).all() and (np.append(0, ends)[first] == stop - sizes).all():
                for i, a, b in zip(bare + led, first.tolist(), (last + 1).tolist()):
                    found[i] = ids[a:b]
            else:
                alone += bare + led
        for i, ids in zip(alone, self._library([words[i] for i in alone])):
            found[i] = ids
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def batch_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offsets of each row's ids."""
        data, rows = utf8(column)
        bounds, before = piece_bounds(data, rows)
        if len(bounds) == 1:
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        begin, size = bounds[:-1], np.diff(bounds)
        h = slice_hashes(data, bounds)
        which = self._find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            if 2 * (self.n + len(first)) > self.slots or self.n_bytes + len(data) >= 1 << 31:
                self._clear()
                _, first = np.unique(h, return_index=True)
            if 2 * len(first) <= self.slots and self.n_bytes + len(data) < 1 << 31:
                self._add(h[first], data, begin[first], size[first])
            which = self._find(h)
        same = (which >= 0).all() and (self.byte_at[which + 1] - self.byte_at[which] == size).all()
        if not same or not np.array_equal(data[bounds[0] : bounds[-1]], self.bytes[ragged(self.byte_at[which], size)]):
            # two pieces share a hash, or a batch has more pieces than the table holds
            ids, counts = self._encode([data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            return ids, offsets_of(counts)[before]
        counts = (self.id_at[which + 1] - self.id_at[which]).astype(np.int64)
        return self.ids[ragged(self.id_at[which], counts)].astype(np.int32), offsets_of(counts)[before]


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` after its first ``used`` places; its length doubles as needed."""
    if used + len(more) > len(array):
        wider = np.zeros(2 * (used + len(more)), array.dtype)  # memory that isn't used yet isn't taken
        wider[:used] = array[:used]
        array = wider
    array[used : used + len(more)] = more
    return array


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _added(path: str) -> dict[str, int]:
    """The file's added tokens, longest first."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    for token in tokens:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"added token {token['content']!r}: only plain added tokens are known")
    return {t["content"]: t["id"] for t in sorted(tokens, key=lambda t: -len(t["content"]))}


def text_ids(column: pa.Array, known: Pieces, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and the offsets of each row's ids; texts are cut at added tokens before they become pieces."""
    if not any(pc.any(pc.match_substring(column, token)).as_py() for token in added):
        return known.batch_ids(column)
    cut = re.compile("(" + "|".join(map(re.escape, added)) + ")")
    spans, after, rows = [], [], [0]
    for text in column.to_pylist():
        found = cut.split(text or "")
        spans += found[::2]
        after += [added[token] for token in found[1::2]]
        after.append(-1)
        rows.append(len(spans))
    ids, offsets = known.batch_ids(pa.array(spans, column.type))
    token = np.array(after, np.int64)
    closed = token >= 0
    sizes = np.diff(offsets)
    ends = offsets_of(sizes + closed)
    out = np.empty(int(ends[-1]), np.int32)
    out[ragged(ends[:-1], sizes)] = ids
    out[ends[1:][closed] - 1] = token[closed]
    return out, ends[np.array(rows)]


def _with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets) + 1
    ends = offsets_of(sizes)
    out = np.full(int(ends[-1]), end_id, np.int32)
    out[ragged(ends[:-1], sizes - 1)] = ids
    return out, ends


def encode_sorted(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """(doc_id, part, at, n, ids binary): ids as 16 or 32 bit numbers, ``at`` ids after the range's start.

    The texts are dealt by ranges of doc_id, so that all later steps are maps.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        known, added = _pieces(tokenizer_file), _added(tokenizer_file)
        for whole in batches:
            for rows in pieces(whole, "text", TEXT_BYTES):
                ids, offsets = _with_end(*text_ids(rows.column("text"), known, added), end_id)
                raw, cuts = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["doc_id", "part", "at", "n", "ids"],
                )
                at += int(offsets[-1])

    return ranged.mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    counts = batch.column("n").to_numpy()
    raw = b"".join([x.as_buffer().to_pybytes() for x in column])
    return np.frombuffer(raw, "<u4").astype(np.int64), offsets_of(counts)


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, count) over all ids; each task sends one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                got = np.bincount(_ids_of(batch)[0])
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "count"])

    return encoded.select("n", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits, by merging packages of two.

    ``counts`` are positive.  Every level's list holds all symbols and the
    pairs of the level below; a symbol's length is how many of the first
    2n - 2 entries of the last list contain it.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit in {most} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, weights = [], leaf
    is_leaf = np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(is_leaf)
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
        both = np.concatenate([leaf, packages])
        rank = np.argsort(both, kind="stable")
        weights, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray) -> None:
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order], bits[order]
        span = np.int64(1) << (MAX_BITS - self.bits)
        at = offsets_of(span)[:-1]  # codes are the starts of their shares of the table
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids] = (at >> (MAX_BITS - self.bits)).astype(np.uint64)
        self.size[self.ids] = self.bits
        entry = self.ids << 8 | self.bits
        self.table = np.zeros(1 << MAX_BITS, np.int64)
        filled = np.repeat(entry, span)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ids one after another, and the bit at every STEP-th id."""
        size = self.size[ids]
        at = offsets_of(size)
        start = at[:-1]
        wide = self.code[ids] << (np.uint64(64) - (start & 31).astype(np.uint64) - size.astype(np.uint64))
        words = int(at[-1] >> 5) + 2
        high, low = (wide >> np.uint64(32)).astype(np.float64), (wide & np.uint64(0xFFFFFFFF)).astype(np.float64)
        out = np.bincount(start >> 5, high, words) + np.bincount((start >> 5) + 1, low, words)
        return out.astype(">u4").tobytes(), start[::STEP]

    def unpack(self, streams: list[bytes], checkpoints: list[np.ndarray], totals: list[int]) -> list[np.ndarray]:
        """The ids of several blocks; all checkpoints advance side by side, one id a round."""
        data = np.frombuffer(b"".join(streams) + b"\0" * 8, ">u4").astype(np.uint64)
        base = offsets_of(np.array([len(s) * 8 for s in streams], np.int64))[:-1]
        bit = np.concatenate([b + c for b, c in zip(base, checkpoints)] or [np.zeros(0, np.int64)])
        left = np.concatenate([np.minimum(STEP, t - STEP * np.arange(len(c))) for t, c in zip(totals, checkpoints)] or [np.zeros(0, np.int64)])
        out = np.zeros((len(bit), STEP), np.int64)
        order = np.argsort(-left, kind="stable")
        bit, left = bit[order], left[order]
        for k in range(STEP):
            n = int(np.searchsorted(-left, -k, side="left"))
            if n == 0:
                break
            now = bit[:n]
            word = now >> 5
            pair = data[word] << np.uint64(32) | data[word + 1]
            peek = (pair >> (np.uint64(64 - MAX_BITS) - (now & 31).astype(np.uint64))) & np.uint64((1 << MAX_BITS) - 1)
            entry = self.table[peek.astype(np.int64)]
            out[order[:n], k] = entry >> 8
            bit[:n] += entry & 255
        result, row = [], 0
        for t, c in zip(totals, checkpoints):
            result.append(out[row : row + len(c)].ravel()[:t])
            row += len(c)
        return result


def write_blocks(encoded: DataFrame, path: str) -> None:
    """Write the files of encoded documents (see the module's text) to ``path``."""
    spark = encoded.sparkSession
    counted = id_counts(encoded).toPandas()  # a row per id of the vocabulary
    ids, counts = counted["id"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)
    bits = code_lengths(counts)
    lengths = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(ids, counts, bits)], "id long, count long, bits int")
    lengths.coalesce(1).write.parquet(f"{path}/lengths")
    code = Code(ids, bits)
    parts = encoded.groupBy("part").agg(F.sum("n").alias("n"))  # a row per range
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = encoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            offsets = offsets_of(batch.column("n").to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_IDS, side="right")) - 1
                hi = min(max(hi, lo + 1), batch.num_rows)
                rows = batch.slice(lo, hi - lo)
                raw, checkpoints = code.pack(_ids_of(rows)[0])
                each = [pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in (rows.column("doc_id"), rows.column("start"), rows.column("n"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(offsets[hi] - offsets[lo])]), pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([raw], pa.binary()), *each],
                    ["n_ids", "checkpoints", "bits", "doc_ids", "starts", "sizes"],
                )
                lo = hi

    schema = "n_ids long, checkpoints array<long>, bits binary, doc_ids array<long>, starts array<long>, sizes array<long>"
    # Huffman codes are as good as random: no codec shortens them
    placed.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of all documents in the files at ``path``."""
    known = spark.read.parquet(f"{path}/lengths").toPandas()  # a row per id of the vocabulary
    code = Code(known["id"].to_numpy(np.int64), known["bits"].to_numpy(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 16):
                batch = whole.slice(lo, 16)
                blocks = code.unpack(
                    [x.as_buffer().to_pybytes() for x in batch.column("bits")],
                    [np.array(x.as_py(), np.int64) for x in batch.column("checkpoints")],
                    batch.column("n_ids").to_pylist(),
                )
                sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids").flatten(), batch.column("starts").flatten(), list_column(np.concatenate(blocks).astype(np.int32), offsets_of(sizes))],
                    ["doc_id", "start", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, ids array<int>")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as files, read them back, return each document's digest."""
    import uuid

    import public_tokenizers

    encoded = staged(encode_sorted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "ids")
    path = f"{scratch(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write_blocks(encoded, path)
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in list_pieces(whole, "ids")):
            column = batch.column("ids")
            counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            raw = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            cuts = (offsets_of(counts) * 4).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
