"""Embedding near-duplicates by cross-polytope hashing.

Each of ``TABLES`` hash tables turns a unit vector ``CODES`` times by a fast
pseudo-random rotation (signs and a Hadamard transform, three times) and takes
the signed axis that lies nearest; the axes of all codes name the vector's home
bucket.  Multiprobe: a vector also looks into the buckets it would have with
the second nearest axis in one code.  Two vectors meet where one of them is at
home.  Every meeting is verified by the cosine in double precision, and a pair
counts at its first meeting only (the vectors carry all their buckets), so the
numbers of links are exact over the pairs that meet.

Equal vectors of a label are one class, which is hashed once.  A crowded bucket
is cut into blocks, of which any two meet in one task; a task gives counts and
a spanning forest of its links, never pairs.

Defined results: vectors that are null, empty or zero, or that hold null or
non-finite numbers, and vectors without label link with nothing; vectors of
different lengths never link; rows with equal or null vec_id are vectors of
their own, and a component's id is its smallest non-null vec_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import mix64, staged, table
from scorewise.llm.components import components
from scorewise.llm.minhash import _groups, _sorted_groups, _spans

TABLES, CODES = 8, 2
POSTS = 1 + CODES  # the home bucket and the probes
SHARE = 0.93
BLOCK = 1024


def _signs(code: int, turn: int, size: int) -> np.ndarray:
    bits = mix64(np.arange(size, dtype=np.uint64) + np.uint64((code * 3 + turn + 1) << 32))
    return np.where(bits & np.uint64(1), 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two (not scaled)."""
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return x


def buckets(unit: np.ndarray) -> np.ndarray:
    """[row, table, post] bucket numbers: the home bucket first, then the probes."""
    n, dim = unit.shape
    size = 1 << max(1, int(dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    rows = np.arange(n)
    best, second = np.empty((TABLES, CODES, n), np.int64), np.empty((TABLES, CODES, n), np.int64)
    for t in range(TABLES):
        for c in range(CODES):
            x = padded
            for turn in range(3):
                x = hadamard(x * _signs(t * CODES + c, turn, size))
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            first = np.abs(x[rows, top[:, 0]]) >= np.abs(x[rows, top[:, 1]])
            a, b = np.where(first, top[:, 0], top[:, 1]), np.where(first, top[:, 1], top[:, 0])
            best[t, c], second[t, c] = a * 2 + (x[rows, a] < 0), b * 2 + (x[rows, b] < 0)
    out = np.empty((n, TABLES, POSTS), np.int64)
    for t in range(TABLES):
        for p in range(POSTS):
            value = np.zeros(n, np.int64)
            for c in range(CODES):
                value = value * (2 * size) + (second if p == c + 1 else best)[t, c]
            out[:, t, p] = value
    return out


def _hashed(rows: DataFrame) -> DataFrame:
    """(vec_id, node, vec, posts): node names the class of equal vectors, null if the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                label = batch.column("label")
                node = np.zeros(batch.num_rows, np.int64)
                vec: list[bytes | None] = [None] * batch.num_rows
                posts: list[bytes | None] = [None] * batch.num_rows
                labels = label.to_pylist()
                for at, x in _matrices(batch.column("embedding"), label.is_valid().to_numpy(zero_copy_only=False)):
                    rows, codes = x.tobytes(), buckets(unit_rows(x)).astype("<i8")
                    wide, long, code = 8 * x.shape[1], codes[0].nbytes, codes.tobytes()
                    for j, i in enumerate(at.tolist()):
                        vec[i], posts[i] = rows[j * wide : (j + 1) * wide], code[j * long : (j + 1) * long]
                        key = hashlib.blake2b(vec[i] + repr(labels[i]).encode(), digest_size=8).digest()
                        node[i] = int.from_bytes(key, "little", signed=True)
                none = np.array([v is None for v in vec])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(node, mask=none), label, pa.array(vec, pa.binary()), pa.array(posts, pa.binary())], ["vec_id", "node", "label", "vec", "posts"])

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, node long, label {kinds['label']}, vec binary, posts binary"
    return rows.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def _matrices(vectors: pa.ListArray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, doubles [row, component]) of the vectors that can link, one matrix for each number of components."""
    size = np.where(wanted, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    start = vectors.offsets.to_numpy()[:-1].astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)  # null components become NaN
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        x = values[start[at][:, None] + np.arange(n)].astype(np.float64) + 0.0  # -0 becomes 0
        links = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if links.any():
            yield at[links], x[links]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[pair, table]: whether b has a post in a's home bucket."""
    return (b == a[:, :, :1]).any(axis=2)


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component under links a[i] - b[i]."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def links(classes: DataFrame, share: float) -> DataFrame:
    """(node, linked, other): vectors that a task found linked to a node, and a node of the same component."""
    number = F.posexplode(F.sequence(F.lit(0), F.lit(TABLES * POSTS - 1)))
    posted = classes.select("node", "label", "vec", "posts", "n", number.alias("at", "_")).drop("_")
    home = (F.col("at") % POSTS) == 0
    place = F.xxhash64("label", F.octet_length("vec"), F.floor(F.col("at") / POSTS), F.substring(F.col("posts"), 8 * F.col("at") + 1, F.lit(8)))
    slim = posted.select(place.alias("bucket"), "node", (F.col("at") / POSTS).cast("int").alias("t"), home.alias("home"))
    crowd = slim.groupBy("bucket").agg(F.count("*").alias("members"), F.max("home").alias("lived")).filter("members > 1 and lived")
    met = slim.join(crowd, "bucket").join(classes.select("node", "vec", "posts", "n"), "node")
    nb = F.ceil(F.col("members") / BLOCK).cast("int")
    b = F.pmod(F.xxhash64(F.lit("block"), "node"), nb).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    blocks = met.withColumn("nb", nb).withColumn("b", b).withColumn("pair", F.explode(pairs))
    rows = blocks.select(
        F.xxhash64("bucket", "pair").alias("group"), "node", "t", "home", "vec", "posts", "n", "b", (F.col("pair.i") == F.col("pair.j")).alias("inner")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "group"):
            keys, node, t, home, n, b, inner = (part.column(c).to_numpy() for c in ("group", "node", "t", "home", "n", "b", "inner"))
            vec, posts = part.column("vec").to_pylist(), part.column("posts").to_pylist()
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in _spans(keys):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                got = _group_links(
                    node[lo:hi], int(t[lo]), home[lo:hi], n[lo:hi], b[lo:hi], bool(inner[lo]),
                    np.frombuffer(b"".join(vec[lo:hi])).reshape(hi - lo, -1),
                    np.frombuffer(b"".join(posts[lo:hi]), "<i8").reshape(hi - lo, TABLES, POSTS), share,
                )
                for to, x in zip(out, got):
                    to.append(x)
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(columns, ["node", "linked", "other"])

    return _sorted_groups(rows, "group").mapInArrow(run, "node long, linked long, other long")


def _group_links(node, t, home, n, block, inner, vec, posts, share):
    x = unit_rows(vec)
    size = len(node)
    linked = np.zeros(size, np.int64)
    firsts, seconds = [], []
    for lo in range(0, size, 256):
        like = x[lo : lo + 256] @ x.T >= share
        a, c = np.nonzero(like)
        a += lo
        keep = (node[a] < node[c]) & (home[a] | home[c])
        if not inner:
            keep &= block[a] != block[c]
        a, c = a[keep], c[keep]
        firsts.append(a)
        seconds.append(c)
        met_a, met_c = _met(posts[a], posts[c]), _met(posts[c], posts[a])
        earlier = (met_a | met_c)[:, :t].any(axis=1)
        counted = ~earlier & (home[a] | ~met_a[:, t])
        np.add.at(linked, a[counted], n[c[counted]])
        np.add.at(linked, c[counted], n[a[counted]])
    a, c = np.concatenate(firsts), np.concatenate(seconds)
    label = _labels(size, a, c)
    told = np.flatnonzero((linked > 0) | (label != np.arange(size)))
    return node[told], linked[told], node[label[told]]


def near_vectors(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    found = staged(_hashed(rows), "vectors")
    able = found.filter("node is not null")
    classes = able.groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("posts").alias("posts"))
    classes = staged(classes, "vector-classes")
    seen = staged(links(classes, share), "vector-links")
    counts = seen.groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = components(seen.select(F.col("node").alias("u"), F.col("other").alias("v")))
    members = classes.select("node", "n", "least").join(counts, "node", "left").join(groups, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    roots = members.groupBy("component").agg(F.min("least").alias("root"))
    told = members.join(roots, "component").select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "root")
    out = found.select("vec_id", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("root")).cast("long")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between all vectors of equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
