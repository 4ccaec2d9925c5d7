"""Exact substring de-duplication by sorted suffixes of a difference cover.

A string of ``LENGTH`` bytes is removed wherever it also starts earlier.  A
full suffix array would sort a row for every byte of the corpus.  A difference
cover sorts only sampled suffixes, as long as any two equal strings hold a
sampled position at the same place; the rest follow from these.  The cover here
depends on content: the sample of a string is the position of its smallest
triple of 8-byte words (the leftmost one among equals), so equal strings have
equal samples wherever they stand, with two samples in 78 bytes.

1. Sampled triples are named, and the names counted over all documents.  A
   triple that occurs once can't start a repeat, and its suffix is done.
2. Recursion on names: a repeated sample goes on with its name and all bytes
   of the strings that it stands for (its context).  Equal (name, context)
   pairs get one name in turn, by hash and then byte by byte; all but the
   first of them are repeats.
3. The remaining suffixes, those that start at the up to 77 unsampled bytes
   before a sample, are merged in: within a name, the strings of different
   contexts are sorted by place and content.
4. Adjacent prefixes of ``LENGTH`` bytes are compared byte by byte; of a run
   of equal ones, all but the first are repeats.

Strings of very frequent names meet as rows of a distributed aggregation
instead of one task, there by 128 bits of hashes.  Texts may be as long as
Spark's strings: long ones are sampled in overlapping slices.  Everything a document loses comes
back to it as intervals.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose
nothing and cause nothing; matches never cross documents; "earlier" is by id
(nulls first), then by place; rows that share an id are ordered by their text
and equal rows are one document, listed as often as they occur; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewise.llm.common import add_uid, free_name, mix64, offsets_of, pieces, ragged, release, staged, table, utf8, with_uid
from scorewise.llm.minhash import _groups

LENGTH = 100
TRIPLE = 24  # three words of 8 bytes
WINDOW = LENGTH - TRIPLE + 1
#: Contexts of one name that one task compares; names with more are dealt out by string.
CROWDED = 20_000
#: Bits of a place in a text; no string of Spark's is longer.
PLACE = 31
#: Strings that start in so many bytes of a text are sampled at once.
SLICE = 32 << 20
#: Contexts of crowded names that a task remembers, to send each one on once.
REMEMBERED = 20_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def samples(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, place, offset, strings) of all samples, ordered by place.

    The sample at byte ``place`` stands for ``strings`` successive strings, the
    first of which starts ``offset`` bytes before it.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    words = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    m = n - TRIPLE + 1
    name = words[:m] * np.uint64(0x9FB21C651E98DF25)
    name ^= words[8 : 8 + m] * np.uint64(0xD6E8FEB86659FD93)
    name = mix64(name)
    name ^= words[16 : 16 + m] * np.uint64(0xA0761D6478BD642F)
    name = mix64(name)
    low = np.uint64((1 << PLACE) - 1)  # equal high bits: the leftmost one
    value = (name & ~low) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    rest = WINDOW - span
    value = np.minimum(value[: len(value) - rest], value[rest:]) if rest else value
    size = np.diff(rows)
    strings = np.maximum(size - LENGTH + 1, 0)
    starts = ragged(rows[:-1], strings)  # where strings of one document start
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    place = (value[starts] & low).astype(np.int64)
    edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first, where = starts[edge], place[edge]
    return name[where], where, where - first, np.diff(np.append(edge, len(starts)))


def _pack(place: np.ndarray, offset: np.ndarray, strings: np.ndarray) -> np.ndarray:
    return place << 14 | offset << 7 | strings


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string's start, offset, strings)."""
    offset = packed >> 7 & 127
    return (packed >> 14) - offset, offset, packed & 127


def _run(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """An interval as one negative number, so that it can stand among packed samples."""
    return -1 - (start << PLACE | length)


def _slices(data: np.ndarray, rows: np.ndarray, at_once: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, data, rows) as they are, or a single long text in slices, each string in one of them."""
    if len(rows) != 2 or len(data) <= at_once + LENGTH:
        yield 0, data, rows
        return
    for lo in range(0, len(data) - LENGTH + 1, at_once):
        some = data[lo : lo + at_once + LENGTH - 1]
        yield lo, some, np.array([0, len(some)], np.int64)


def _samples_of(data: np.ndarray, rows: np.ndarray, number: np.ndarray, before: int) -> pa.RecordBatch:
    """``sampled`` for texts (numbers, bytes and bounds) that begin ``before`` bytes after their documents."""
    name, place, offset, strings = samples(data, rows)
    row = np.searchsorted(rows, place, side="right") - 1
    begin, size = place - offset, strings + (LENGTH - 1)
    alike = (name[1:] == name[:-1]) & (offset[1:] == offset[:-1]) & (strings[1:] == strings[:-1]) & (row[1:] == row[:-1])
    raw, gone = data.tobytes(), np.zeros(len(name) + 1, bool)
    for i in np.flatnonzero(alike).tolist():
        x, y, n = int(begin[i]), int(begin[i + 1]), int(size[i])
        gone[i + 1] = raw[x : x + n] == raw[y : y + n]
    first = np.flatnonzero(gone[1:] & ~gone[:-1]) + 1
    last = np.flatnonzero(gone[:-1] & ~gone[1:])
    local = begin - rows[row] + before if len(row) else begin
    runs = _run(local[first], begin[last] + size[last] - begin[first])
    kept = ~gone[: len(name)]
    uid = number[row] if len(row) else np.zeros(0, np.int64)
    names = np.concatenate([name[kept], mix64(uid[first].astype(np.uint64))]).view(np.int64)
    packed = np.concatenate([_pack(local[kept] + offset[kept], offset[kept], strings[kept]), runs])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([uid[kept], uid[first]])), pa.array(packed)], ["name", "uid", "packed"])


def sampled(docs: DataFrame) -> DataFrame:
    """(name, uid, packed): the samples of all texts.

    Where a text repeats itself at once, successive samples have equal contexts:
    the first of them stays, the others are repeats already and come as one
    interval (packed is negative).
    """
    at_once = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text", min(2_000_000, at_once)):
                number = part.column("uid").to_numpy()
                for before, data, rows in _slices(*utf8(part.column("text")), at_once):
                    yield _samples_of(data, rows, number, before)

    return docs.select("uid", "text").mapInArrow(run, "name long, uid long, packed long")


class Remembered:
    """Contexts of crowded names that a task has sent on, the earliest of each.

    One that comes later in the corpus than an equal one is a repeat already:
    it needs no row, and a passage that millions of documents share leaves a
    task about once.  The memory is emptied when it is full; that costs rows only.
    """

    def __init__(self, room: int) -> None:
        self.room = room
        self.known: dict[tuple[int, int], tuple[int, int, bytes]] = {}

    def later(self, name: int, inner: int, uid: int, packed: int, context: bytes) -> bool:
        old = self.known.get((name, inner))
        if old is not None and old[:2] < (uid, packed):
            return old[2] == context
        if len(self.known) >= self.room:
            self.known.clear()
        self.known[name, inner] = (uid, packed, context)
        return False


def contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(name, inner, uid, packed, crowded, context): repeated samples with the bytes of all their strings.

    The context is null where the sample is known to repeat an earlier one.
    """
    lists = repeated.groupBy("uid").agg(F.collect_list(F.struct("name", "packed", (F.col("n") > CROWDED).alias("crowded"))).alias("samples"))
    rows = docs.select("uid", "text").join(lists.hint("merge"), "uid").select("uid", "text", "samples.name", "samples.packed", "samples.crowded")
    room = REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mark = Remembered(room), [bytes([o]) for o in range(128)]
        for whole in batches:
            for part in pieces(whole, "text", 1_000_000):
                data, bounds = utf8(part.column("text"))
                raw = memoryview(data)
                counts = part.column("name").value_lengths().to_numpy()
                columns = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("name", "packed", "crowded")]
                base, uids = np.repeat(bounds[:-1], counts), np.repeat(part.column("uid").to_numpy(), counts)
                for lo in range(0, len(uids), 20_000):
                    cut = slice(lo, lo + 20_000)
                    name, packed, crowded = (c[cut] for c in columns)
                    uid = uids[cut]
                    first, offset, strings = _unpack(packed)
                    begin = first + base[cut]
                    end = begin + strings + (LENGTH - 1)
                    found: list = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                    inner = [int.from_bytes(hashlib.blake2b(c + mark[o], digest_size=8).digest(), "little", signed=True) for c, o in zip(found, offset.tolist())]
                    for i in np.flatnonzero(crowded).tolist():
                        if seen.later(int(name[i]), inner[i], int(uid[i]), int(packed[i]), found[i]):
                            found[i] = None
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name), pa.array(inner, pa.int64()), pa.array(uid), pa.array(packed), pa.array(crowded), pa.array(found, pa.binary())],
                        ["name", "inner", "uid", "packed", "crowded", "context"],
                    )

    return rows.mapInArrow(run, "name long, inner long, uid long, packed long, crowded boolean, context binary")


class Strings:
    """All strings of contexts: keys of name, place and content, in the contexts' order."""

    def __init__(self, name: np.ndarray, packed: np.ndarray, found: pa.Array) -> None:
        self.data, bounds = utf8(found)
        self.first, offset, self.count = _unpack(packed)
        self.row = np.repeat(np.arange(len(packed)), self.count)
        step = np.arange(len(self.row)) - np.repeat(offsets_of(self.count)[:-1], self.count)
        self.at = bounds[self.row] + step
        self.start = self.first[self.row] + step
        n = len(self.data)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n, _MULTIPLIER, np.uint64))
            down = np.cumprod(np.full(n, pow(_MULTIPLIER, -1, 2**64), np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * up, out=sums[1:])
        content = (sums[self.at + LENGTH] - sums[self.at]) * down[self.at]
        place = (offset[self.row] - step).astype(np.uint64)
        self.key = mix64(mix64(content) + name.view(np.uint64)[self.row] * np.uint64(0xA0761D6478BD642F) + place * np.uint64(0xD6E8FEB86659FD93))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether strings a[i] and b[i] have the same bytes."""
        out = np.empty(len(a), bool)
        width = np.arange(LENGTH)
        for lo in range(0, len(a), 10_000):
            x, y = self.at[a[lo : lo + 10_000]], self.at[b[lo : lo + 10_000]]
            out[lo : lo + 10_000] = (self.data[x[:, None] + width] == self.data[y[:, None] + width]).all(axis=1)
        return out


def _intervals(uid: np.ndarray, strings: Strings, marked: np.ndarray) -> pa.RecordBatch:
    """(uid, at, to) of the bytes that marked strings cover, one for each run of strings."""
    hit = np.flatnonzero(marked)
    new = np.append(True, (np.diff(hit) > 1) | (strings.row[hit][1:] != strings.row[hit][:-1])) if len(hit) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1 if len(hit) else head
    start, stop = strings.start[hit[head]], strings.start[hit[tail]] + LENGTH
    return pa.RecordBatch.from_arrays([pa.array(uid[strings.row[hit[head]]]), pa.array(start), pa.array(stop)], ["uid", "at", "to"])


def _whole(uid: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    """The intervals of samples all of whose strings are repeats."""
    first, _, strings = _unpack(packed)
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(first), pa.array(first + strings + (LENGTH - 1))], ["uid", "at", "to"])


def _compared(rows: DataFrame) -> DataFrame:
    """Repeats among the contexts of each name, as (uid, at, to).

    The rows of a name meet in one task.  A crowded name is dealt out by the
    names of its contexts: equal contexts meet (a map task sends each about
    once, the others are known as repeats), and the first of each comes back
    (name, packed and context are not null) to be compared by ``_dealt``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, "group"):
            groups = whole.column("group").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
            lo = 0
            while lo < len(groups):  # runs of whole groups, of some thousand contexts
                hi = int(cuts[min(np.searchsorted(cuts, lo + 10_000), len(cuts) - 1)])
                some = whole.slice(lo, hi - lo)
                lo = hi
                known = pc.is_null(some.column("context"))
                yield _told(_whole(*(some.filter(known).column(c).to_numpy() for c in ("uid", "packed"))))
                some = some.filter(pc.invert(known))
                if not some.num_rows:
                    continue
                group, name, inner, uid, packed, crowded = (some.column(c).to_numpy() for c in ("group", "name", "inner", "uid", "packed", "crowded"))
                # the names of names: rows come by place in the corpus, so the first of each is the earliest
                _, first, which = np.unique(mix64(name.view(np.uint64)) ^ inner.view(np.uint64), return_index=True, return_inverse=True)
                lead = first[which]
                context = some.column("context")
                same = pc.equal(context, context.take(pa.array(lead))).to_numpy(zero_copy_only=False).astype(bool)
                same &= (name == name[lead]) & ((packed >> 7 & 127) == (packed[lead] >> 7 & 127))
                later = same & ((uid != uid[lead]) | (packed != packed[lead]))
                yield _told(_whole(uid[later], packed[later]))
                keep = ~same  # equal hashes of other bytes
                keep[first] = True
                at = np.flatnonzero(keep & ~crowded)
                if len(at):
                    new = np.append(True, group[at][1:] != group[at][:-1])
                    size = np.diff(np.append(np.flatnonzero(new), len(at)))
                    at = at[np.repeat(size > 1, size)]
                if len(at):
                    # groups are names but for hash collisions; strings of a name come by place
                    at = at[np.argsort(name[at], kind="stable")]
                    yield _told(_first_strings(name[at], uid[at], packed[at], some.column("context").take(pa.array(at)).combine_chunks()))
                at = np.flatnonzero(keep & crowded)
                if len(at):
                    none = pa.nulls(len(at), pa.int64())
                    kept = some.column("context").take(pa.array(at)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(uid[at]), none, none, pa.array(name[at]), pa.array(packed[at]), kept], ["uid", "at", "to", "name", "packed", "context"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.when(F.col("crowded"), F.pmod("inner", F.lit(1024))).otherwise(F.lit(-1))
    group = F.when(F.col("context").isNull(), F.xxhash64("uid", "packed")).otherwise(F.xxhash64("name", dealt))
    ordered = rows.withColumn("group", group).repartition(n, "group").sortWithinPartitions("group", "uid", "packed")
    return ordered.mapInArrow(run, "uid long, at long, to long, name long, packed long, context binary")


def _told(marks: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(marks.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([*marks.columns, none, none, pa.nulls(marks.num_rows, pa.binary())], ["uid", "at", "to", "name", "packed", "context"])


def _first_strings(name: np.ndarray, uid: np.ndarray, packed: np.ndarray, found: pa.Array) -> pa.RecordBatch:
    """Repeats among the strings of different contexts of some names; rows come by name, then by place."""
    strings = Strings(name, packed, found)
    order = np.argsort(strings.key, kind="stable")
    key = strings.key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    same = same[strings.equal(order[same], order[same + 1])]
    follows = np.zeros(len(order), bool)
    follows[same + 1] = True
    first = order[np.maximum.accumulate(np.where(follows, 0, np.arange(len(order))))]
    own = (uid[strings.row[order]] == uid[strings.row[first]]) & (strings.start[order] == strings.start[first])
    marked = np.zeros(len(order), bool)
    marked[order] = follows & ~own
    return _intervals(uid, strings, marked)


def _dealt(rows: DataFrame) -> DataFrame:
    """The same for crowded names: every string is a row, equal strings meet in an aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "context", 1_000_000):
                strings = Strings(part.column("name").to_numpy(), part.column("packed").to_numpy(), part.column("context"))
                raw = strings.data.tobytes()
                second = [int.from_bytes(hashlib.blake2b(raw[a : a + LENGTH], digest_size=8).digest(), "little", signed=True) for a in strings.at.tolist()]
                uid = part.column("uid").to_numpy()[strings.row]
                yield pa.RecordBatch.from_arrays([pa.array(strings.key.view(np.int64)), pa.array(second, pa.int64()), pa.array(uid), pa.array(strings.start)], ["key", "second", "uid", "at"])

    strings = staged(rows.mapInArrow(run, "key long, second long, uid long, at long"), "strings")
    firsts = strings.groupBy("key", "second").agg(F.min(F.struct("uid", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(firsts, ["key", "second"]).filter(F.struct("uid", "at") != F.col("first"))
    return later.select("uid", "at", (F.col("at") + LENGTH).alias("to"))


def repeats(docs: DataFrame) -> DataFrame:
    """(uid, spans array<struct<at, to>>) of documents (uid, text) with repeats: unordered, overlapping intervals of bytes."""
    known = sampled(docs).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    known = staged(known.filter("n > 1 or packed < 0"), "repeated-names")
    release(docs.sparkSession)  # the samples' shuffle files can go before the texts are shuffled
    number = -1 - F.col("packed")
    start = F.shiftright(number, PLACE)
    runs = known.filter("packed < 0").select("uid", start.alias("at"), (start + number.bitwiseAND(F.lit((1 << PLACE) - 1))).alias("to"))
    found = staged(_compared(contexts(docs, known.filter("packed >= 0"))), "compared")
    marks = runs.unionAll(found.filter("at is not null").select("uid", "at", "to"))
    release(docs.sparkSession)
    crowded = found.filter("at is null")
    if not crowded.isEmpty():
        marks = marks.unionAll(_dealt(crowded.select("name", "uid", "packed", "context")))
    return marks.groupBy("uid").agg(F.collect_list(F.struct("at", "to")).alias("spans"))


def _covered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's bytes, row bounds, and which bytes its spans cover."""
    data, rows = utf8(part.column("text"))
    spans = part.column("spans")
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    base = np.repeat(rows[:-1], counts)
    step = np.zeros(len(data) + 1, np.int32)
    if len(flat):
        np.add.at(step, flat.field("at").to_numpy(zero_copy_only=False) + base, 1)
        np.add.at(step, flat.field("to").to_numpy(zero_copy_only=False) + base, -1)
    return data, rows, np.cumsum(step[:-1]) > 0


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, id, n_bytes, n_removed, n_spans, kept binary): every document without its repeats."""
    rows = docs.join(spans.hint("merge"), "uid", "left").select("uid", "id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text"):
                data, rows, gone = _covered(part)
                total, lost = np.diff(rows), offsets_of(gone.astype(np.int64))
                head = gone.copy()
                if len(head):
                    inner = np.ones(len(head), bool)
                    inner[rows[:-1][total > 0]] = False  # a run ends where its document does
                    head[1:] &= ~(gone[:-1] & inner[1:])
                heads = offsets_of(head.astype(np.int64))
                rest = data[~gone].tobytes()
                cuts = (rows - lost[rows]).tolist()
                kept = pa.array([rest[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("id"), pa.array(total), pa.array(lost[rows[1:]] - lost[rows[:-1]]), pa.array(heads[rows[1:]] - heads[rows[:-1]]), kept],
                    ["uid", "id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = dict(docs.dtypes)["id"]
    return rows.mapInArrow(run, f"uid long, id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cut: code points whose bytes are all repeats go, n_chars follows."""
    uid, gone = free_name("_uid", docs.columns), free_name("_spans", docs.columns)
    names = docs.columns
    spans = repeats(with_uid(docs, id_col, text_col)).withColumnsRenamed({"uid": uid, "spans": gone})
    rows = add_uid(docs, uid, id_col, text_col).join(spans.hint("merge"), uid, "left").select(*docs.columns, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, text_col):
                two = pa.RecordBatch.from_arrays([part.column(text_col), part.column(gone)], ["text", "spans"])
                data, bounds, cover = _covered(two)
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                if len(lead):
                    whole_points = np.logical_and.reduceat(cover, lead)
                    cover = np.repeat(whole_points, np.diff(np.append(lead, len(data))))
                lost = offsets_of(cover.astype(np.int64))
                rest, cuts = data[~cover].tobytes(), (bounds - lost[bounds]).tolist()
                texts = pa.array([rest[a:b].decode() for a, b in zip(cuts, cuts[1:])], pa.string(), mask=part.column(text_col).is_null().to_numpy(zero_copy_only=False))
                columns = [texts if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and "text" == text_col:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 100 bytes that also start earlier."""
    docs = with_uid(table(spark, sf_dir, "documents"))
    out = removed(docs, repeats(docs))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
