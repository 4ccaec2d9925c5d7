"""Near-duplicates by an inverted join over signature coordinates, confirmed on full sets.

1. Each text's set of word shingles is hashed to a signature of ``COORDS``
   minima.  Texts with equal sets are one class; only its smallest document
   goes on.
2. A document is posted under its (coordinate, value) pairs.  Documents whose
   sets are at least as similar as the threshold agree on ``MATCHES``
   coordinates or more, but for about two pairs in ten million exactly at
   0.8.  Two documents with that many common pairs have one in their first
   COORDS - MATCHES + 1 pairs, rarest first; only these prefixes are posted,
   and documents with too few shared pairs are skipped.
3. Inside a posting list collisions are counted over whole signatures.  The
   search walks from documents to those not yet reached, so a list of near
   copies costs about its length; it emits a spanning forest, never all pairs.
   Long lists are posted again under pairs of coordinates, and cut into
   blocks of which any two meet in one task.
4. Candidates form components; inside each (again in blocks) links are
   confirmed on the full sets, and the confirmed links give the classes.

Defined results: a null or empty text has an empty set and is linked with
nothing; rows that share an id, or have none, are told apart by their text
(see common.with_uid); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.bpe import slice_hashes
from scorewise.llm.common import mix64, offsets_of, pieces, staged, table, utf8, with_uid
from scorewise.llm.components import components

COORDS, MATCHES = 40, 18
PREFIX = COORDS - MATCHES + 1
#: Members of a posting list that are searched as one block; shingles of a block of full sets.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000

_SPLIT = np.zeros(256, bool)
_SPLIT[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes but white space), and each word's row."""
    solid = ~_SPLIT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    starts = solid & (edge[:-1] | ~np.append(False, solid[:-1]))
    ends = solid & (edge[1:] | ~np.append(solid[1:], False))
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(rows, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    tail = bounds[-1] < len(data)
    first = bounds[0] > 0
    gaps = np.concatenate([[0] if first else [], bounds, [len(data)] if tail else []]).astype(np.int64)
    keep = np.flatnonzero(np.diff(gaps) > 0)
    hashes = slice_hashes(data, np.append(gaps[keep], gaps[-1]))
    return hashes[np.searchsorted(gaps[keep], start)]


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the offsets of each row's."""
    data, rows = utf8(column)
    data = _LOWER[data]
    n = len(rows) - 1
    start, end, row = word_bounds(data, rows)
    h = word_hashes(data, start, end)
    count = np.bincount(row, minlength=n)
    out, owner = [], []
    long = count >= words
    if len(h) >= words:
        last = len(h) - words + 1
        value = np.zeros(last, np.uint64)
        for k in range(words):
            value = mix64(value + h[k : k + last] * np.uint64(2 * k + 3))
        inside = row[:last] == row[words - 1 :]
        out.append(value[inside])
        owner.append(row[:last][inside])
    short = np.flatnonzero((count > 0) & ~long)
    if len(short):
        at = offsets_of(count)
        for r in short.tolist():
            value = np.full(1, count[r], np.uint64)
            for k in range(at[r], at[r + 1]):
                value = mix64(value + h[k : k + 1] * np.uint64(7))
            out.append(value)
            owner.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value, who = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.append(True, (value[1:] != value[:-1]) | (who[1:] != who[:-1]))
    value, who = value[new], who[new]
    return value, offsets_of(np.bincount(who, minlength=n))


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:COORDS] | np.uint64(1), seeds[COORDS:]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, coordinate] minima of COORDS hash functions; rows must not be empty."""
    scale, shift = _coordinates()
    out = np.empty((len(offsets) - 1, COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat((values * scale[k] + shift[k]) >> np.uint64(32), offsets[:-1])
    return out


def features(docs: DataFrame, words: int) -> DataFrame:
    """(uid, id, n, d1, d2, sig): set size, a 128-bit digest of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text"):
                value, offsets = shingle_sets(part.column("text"), words)
                n = np.diff(offsets)
                full = np.flatnonzero(n > 0)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig: list[bytes | None] = [None] * len(n)
                if len(full):
                    begin = offsets[:-1][full]
                    d1[full] = np.add.reduceat(mix64(value), begin)
                    d2[full] = np.add.reduceat(mix64(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
                    rows = signatures(value, np.append(begin, len(value)))
                    for r, s in zip(full.tolist(), rows):
                        sig[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("id"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["uid", "id", "n", "d1", "d2", "sig"],
                )

    id_type = dict(docs.dtypes)["id"]
    return docs.select("uid", "id", "text").mapInArrow(run, f"uid long, id {id_type}, n long, d1 long, d2 long, sig binary")


def forest(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of ``size`` members.

    ``near(i, others)`` says which of the others are linked to i.  The walk asks
    for members not yet reached only: members of one component cost little more
    than their number.
    """
    left = np.arange(size)
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            links += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return links


def _in_blocks(rows: DataFrame, key: str, blocks, order: str) -> DataFrame:
    """Rows of a group in ``blocks`` blocks; each row goes to every pair of blocks that has its own."""
    nb = rows.withColumn("nb", blocks)
    b = F.pmod(F.xxhash64(F.lit("block"), F.col(order)), F.col("nb")).cast("int")
    pair = F.when(
        F.col("nb") == 1, F.array(F.lit("0"))
    ).otherwise(
        F.transform(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")), lambda o: F.concat_ws(":", F.least(o, F.col("b")), F.greatest(o, F.col("b"))))
    )
    return nb.withColumn("b", b).withColumn("pair", F.explode(pair)).withColumn("group", F.xxhash64(F.col(key), "pair")).drop("nb", "b", "pair")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(keys):
        return
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    yield from zip(edge, [*edge[1:], len(keys)])


def _sorted_groups(rows: DataFrame, key: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key)


def candidate_links(reps: DataFrame, share: float) -> DataFrame:
    """Links (u, v) that span all groups of documents that agree on MATCHES coordinates."""
    tokens = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * i + 1, 4)) for i in range(COORDS)])
    posts = reps.select("uid", F.explode(tokens).alias("token"))
    counts = posts.groupBy("token").count().filter("count > 1")
    shared = posts.join(counts, "token")
    by_rarity = F.array_sort(F.collect_list(F.struct("count", "token")))
    prefix = shared.groupBy("uid").agg(by_rarity.alias("t")).filter(F.size("t") >= MATCHES)
    prefix = prefix.select("uid", F.slice("t", 1, F.size("t") - (MATCHES - 1)).alias("p"), "t")
    prefix = staged(prefix, "prefixes")
    lists = prefix.select("uid", F.explode("p").alias("p"), "t").select("uid", "p.token", "p.count", "t")
    near = lists.filter(F.col("count") <= BLOCK).select("uid", F.xxhash64("token").alias("list"))
    # a long list is posted again under each pair of its token and another one of the prefix
    others = F.filter("t", lambda x: x["token"] != F.col("token"))
    pairs = lists.filter(F.col("count") > BLOCK).select("uid", "token", F.explode(F.slice(others, 1, F.size(others) - (MATCHES - 2))).alias("o"))
    pairs = pairs.select("uid", F.xxhash64(F.least("token", "o.token"), F.greatest("token", "o.token")).alias("list"))
    posted = near.unionAll(pairs.distinct())
    sizes = posted.groupBy("list").agg(F.count("*").alias("members")).filter("members > 1")
    posted = posted.join(sizes, "list").join(reps.select("uid", "n", "sig"), "uid")
    grouped = _in_blocks(posted, "list", F.ceil(F.col("members") / BLOCK), "uid").select("group", "uid", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "group"):
            keys, uid, n = (part.column(c).to_numpy() for c in ("group", "uid", "n"))
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            us, vs = [], []
            for lo, hi in _spans(keys):
                s, m = sig[lo:hi], n[lo:hi]

                def near(i: int, others: np.ndarray, s=s, m=m) -> np.ndarray:
                    fits = np.minimum(m[others], m[i]) >= share * np.maximum(m[others], m[i])
                    hit = np.zeros(len(others), bool)
                    hit[fits] = (s[others[fits]] == s[i]).sum(axis=1) >= MATCHES
                    return hit

                for a, b in forest(hi - lo, near):
                    us.append(uid[lo + a])
                    vs.append(uid[lo + b])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _sorted_groups(grouped, "group").mapInArrow(run, "u long, v long")


def confirmed_links(docs: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) of 100 * intersection >= percent * union that span each group's components.

    ``groups``: (uid, n, component).  The full sets are built again from the texts.
    """
    sizes = groups.groupBy("component").agg(F.sum("n").alias("shingles"))
    members = groups.join(sizes, "component").select("uid", "component", "shingles")
    # the members grow with the corpus: they are never broadcast to the texts
    chosen = docs.select("uid", "text").join(members.hint("merge"), "uid")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text"):
                value, offsets = shingle_sets(part.column("text"), words)
                raw, cuts = value.tobytes(), (offsets * 8).tolist()
                packed = pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("component"), part.column("shingles"), packed], ["uid", "component", "shingles", "hashes"])

    rows = chosen.select("uid", "component", "shingles", "text").mapInArrow(sets, "uid long, component long, shingles long, hashes binary")
    grouped = _in_blocks(rows, "component", F.ceil(F.col("shingles") / BLOCK_SHINGLES), "uid").select("group", "uid", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "group"):
            keys, uid = part.column("group").to_numpy(), part.column("uid").to_numpy()
            raw = [x.as_buffer() for x in part.column("hashes")]
            us, vs = [], []
            for lo, hi in _spans(keys):
                own = [np.frombuffer(x, np.uint64) for x in raw[lo:hi]]
                for a, b in forest(hi - lo, _similar(own, percent)):
                    us.append(uid[lo + a])
                    vs.append(uid[lo + b])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _sorted_groups(grouped, "group").mapInArrow(run, "u long, v long")


def _similar(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    size = np.array([len(s) for s in sets], np.int64)
    scale, shift = _coordinates()
    flat = np.concatenate(sets)
    sig = signatures(flat, offsets_of(size))
    del flat

    def near(i: int, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(others), bool)
        fits = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
        fits[fits] = (sig[others[fits]] == sig[i]).sum(axis=1) >= MATCHES
        at = np.flatnonzero(fits)
        for lo in range(0, len(at), 256):
            some = at[lo : lo + 256]
            picked = [sets[j] for j in others[some].tolist()]
            values = np.concatenate(picked)
            where = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
            ends = offsets_of(size[others[some]])
            common = np.add.reduceat((sets[i][where] == values).astype(np.int64), ends[:-1])
            union = size[i] + size[others[some]] - common
            hit[some] = 100 * common >= percent * union
        return hit

    return near


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, n_shingles, component, component_id): the smallest uid reachable by links, and its id."""
    base = with_uid(docs, id_col, text_col)
    found = staged(features(base, words), "features")
    classes = found.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("uid").alias("uid"), F.min_by("id", "uid").alias("id"), F.min("sig").alias("sig"))
    reps = staged(classes, "classes")
    groups = components(candidate_links(reps.select("uid", "n", "sig"), percent / 100 - 1e-9))
    groups = staged(groups.join(reps.select(F.col("uid").alias("node"), "n"), "node").select(F.col("node").alias("uid"), "n", "component"), "groups")
    # rows of one uid are equal; one of them is enough
    links = staged(confirmed_links(base, groups, words, percent), "confirmed")
    final = components(links).select(F.col("node").alias("uid"), "component")
    label = reps.join(final, "uid", "left").select("d1", "d2", "n", F.coalesce("component", "uid").alias("component"))
    label = label.join(reps.select(F.col("uid").alias("component"), F.col("id").alias("component_id")), "component")
    rows = found.select("uid", "id", "n", "d1", "d2").join(label, ["d1", "d2", "n"], "left")
    alone = F.col("component").isNull()
    return rows.select(
        "uid",
        "id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("uid")).otherwise(F.col("component")).alias("component"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents: two-word shingles, 0.8 or more."""
    rows = near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("uid") == F.col("component")).alias("kept"))
