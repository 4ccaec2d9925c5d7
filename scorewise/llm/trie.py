"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns.  Its name is a chain of SHA-256
digests over the turns, cut into blocks so that a conversation of any length is
shared among tasks; its key is (smallest member, depth), which is unique.

Sums over subtrees come from a centroid decomposition of the parent edges.  A
component's centroid is its deepest node that still has half of the component's
weight below it (the weight of a node is its number of members, so a node's
weight with all below it is known from the table of members).  In each round
every component is split at its centroid c:

* the centroid's subtree inside the component is totalled;
* the total is added to every node on the way from c to the component's top;
* c leaves, its children become tops, and what is above c stays together.

Half of the weight goes at least in each split, so there are about log2 of the
turns rounds at most, whatever the depth.  Components of at most ``TASK_NODES``
nodes are split on in the same way within a task, many components to a task.
Which child of c a node lies below is looked up in the table of members: the
prefix one turn longer than c's of the node's smallest member.

Defined results: rows without a conversation id belong to no conversation and
are left out; null roles and texts are empty; equal turns are ordered by role,
then text; an empty table gives an empty result; further columns are ignored.
The digest of a node's ends reads their ids in order in one task, batch by
batch: SHA-256 has no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import staged, table
from scorewise.llm.repair import CRC_TABLE, crc_sql
from scorewise.llm.turns import numbered, same_as_before

#: Turns of a conversation whose names are chained in one task.
BLOCK = 1024
#: Parts into which the members of a node are dealt before they meet.
SALTS = 64
#: Nodes of a component that one task splits on.
TASK_NODES = 20_000
#: Turns that a conversation can take from its group's first one: less than this.
HEADS = 9


def running_digest(rows: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: a digest of each row's ``value`` and the digest before it, chained along ``order`` in each group."""
    dealt = rows.repartition(*group).sortWithinPartitions(*group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = [None] * len(group), b""
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for i, name in enumerate(group):
                same &= same_as_before(batch.column(name), last[i])
                last[i] = batch.column(name)[-1]
            chain = []
            for follows, x in zip(same.tolist(), batch.column(value).to_pylist()):
                state = hashlib.sha256((state if follows else b"") + x).digest()
                chain.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chain, pa.binary())], [*batch.schema.names, out])

    return dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + f", {out} binary")


def ids_digest(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``group`` and ``out``: the SHA-256 of the decimal ``value`` numbers, ascending and joined by commas, of each group."""
    dealt = rows.select(*group, value).repartition(*group).sortWithinPartitions(*group, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(g).to_numpy() for g in group])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            begins, done = [0, *edge.tolist()], []
            numbers = batch.column(value).to_pylist()
            for a, b in zip(begins, [*begins[1:], batch.num_rows]):
                key = tuple(keys[:, a].tolist())
                text = ",".join(map(str, numbers[a:b])).encode()
                if key == last:
                    state.update(b"," + text)
                    continue
                if state is not None:
                    done.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(text)
            yield _rows(done)
        if state is not None:
            yield _rows([(*last, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * (len(group) + 1)
        kinds = [*[pa.int64()] * len(group), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*group, out])

    return dealt.mapInArrow(run, ", ".join(f"{g} long" for g in group) + f", {out} string")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv, depth, size, digest, bytes): the turns of all rebuilt conversations, of ``size`` turns each, from (conv, place, digest, bytes).

    Every conversation has a row of depth 0.
    """
    sizes = staged(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "sizes")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    wanted = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = wanted.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    plan = staged(plan.withColumn("size", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "plan")
    # a conversation's turns meet its plan block by block
    block = F.floor(F.col("place") / BLOCK)
    blocks = plan.select("conv", "h", "k", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / BLOCK))).alias("block"))
    own = placed.withColumn("block", block).join(blocks, ["conv", "block"]).filter("place >= h")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("k") + 1).alias("depth"), "size", "digest", "bytes")
    first = placed.filter(F.col("place") < HEADS).select(F.col("conv").alias("base"), "place", "digest", "bytes")
    head = plan.select("conv", "base", "k", "size").join(first, "base").filter("place < k")
    head = head.select("conv", (F.col("place") + 1).alias("depth"), "size", "digest", "bytes")
    roots = plan.select("conv", F.lit(0).cast("long").alias("depth"), "size", F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(head).unionByName(roots)


def members(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, owner, parent, size, bytes): each conversation's prefixes, with the smallest member of the prefix and of the one before."""
    named = running_digest(turns.filter("depth > 0").withColumn("block", F.floor((F.col("depth") - 1) / block)), ["conv", "block"], "depth", "digest", "name")
    named = staged(named.select("conv", "depth", "block", "size", "bytes", "name"), "names")
    if named.filter("block > 0").limit(1).count():
        # the chain of whole blocks before a block is part of the names in it
        ends = named.filter((F.col("depth") == (F.col("block") + 1) * block) & (F.col("size") > F.col("depth"))).select("conv", "block", "name")
        chain = running_digest(ends, ["conv"], "block", "name", "chain").select("conv", (F.col("block") + 1).alias("block"), "chain")
        later = named.filter("block > 0").join(chain, ["conv", "block"])
        later = later.withColumn("name", F.unhex(F.sha2(F.concat("chain", "name"), 256))).drop("chain")
        named = named.filter("block = 0").unionByName(later)
    root = turns.filter("depth = 0").select("conv", "depth", "size", "bytes", F.lit(b"").alias("name"))
    every = named.select("conv", "depth", "size", "bytes", "name").unionByName(root)
    # a prefix may have a third of all conversations: its members are dealt out before they learn the smallest
    salted = every.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)))
    parts = staged(salted.groupBy("depth", "name", "salt").agg(F.min("conv").alias("least")), "prefixes")
    least = parts.groupBy("depth", "name").agg(F.min("least").alias("owner"))
    owners = parts.join(least, ["depth", "name"]).select("depth", "name", "salt", "owner")
    owned = staged(salted.join(owners, ["depth", "name", "salt"]).select("conv", "depth", "owner", "size", "bytes"), "owned")
    above = owned.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    return staged(owned.join(above, ["conv", "depth"], "left"), "members")


def trie(prefixes: DataFrame) -> DataFrame:
    """(owner, depth, parent, n_convs, mass, bytes, n_children) of every node; mass is the sum of n_convs over its subtree."""
    here = prefixes.groupBy("owner", "depth").agg(
        F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("mass"), F.max("bytes").alias("bytes")
    )
    here = staged(here, "nodes")
    children = here.filter("parent is not null").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return here.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def split_component(parents: list[int], values: np.ndarray) -> np.ndarray:
    """Subtree sums of one component; ``parents`` come before their children, tops have -1."""
    n = len(parents)
    out = np.zeros_like(values)
    todo = [list(range(n))]
    mine = [-1] * n  # the component that a node is in, by its number
    number = 0
    while todo:
        nodes = todo.pop()
        number += 1
        for v in nodes:
            mine[v] = number
        size = dict.fromkeys(nodes, 1)
        centroid, half = nodes[0], len(nodes)
        for v in reversed(nodes):
            if 2 * size[v] >= half:
                centroid = v
                break
            size[parents[v]] += size[v]
        below: dict[int, list[int]] = {}
        side: dict[int, int] = {}
        above = []
        for v in nodes:
            p = parents[v]
            if v == centroid:
                continue
            top = v if p == centroid else side.get(p)
            if top is None:
                above.append(v)
            else:
                side[v] = top
                below.setdefault(top, []).append(v)
        total = values[centroid] + values[list(side)].sum(axis=0)
        v = centroid
        while v >= 0 and mine[v] == number:
            out[v] += total
            v = parents[v]
        for part in [above, *below.values()]:
            if len(part) == 1:
                out[part[0]] += values[part[0]]
                mine[part[0]] = -1
            elif part:
                todo.append(part)
        mine[centroid] = -1
    return out


def _within_tasks(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(owner, depth, values): subtree sums inside the components of ``nodes`` (top_owner, top_depth, owner, depth, parent, values)."""
    tops = ["top_owner", "top_depth"]
    columns = [*tops, "depth", "owner", "parent", *values]
    dealt = nodes.select(*columns).repartition(*tops).sortWithinPartitions(*tops, "depth")
    names = ["owner", "depth", *values]

    def solve(rows: np.ndarray) -> np.ndarray:
        """Whole components, rows as ``columns``."""
        edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        sums = rows[:, 5:].copy()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)]):
            if b - a > 1:
                depth, owner, parent = (rows[a:b, k].tolist() for k in (2, 3, 4))
                at = {key: i for i, key in enumerate(zip(owner, depth))}
                sums[a:b] = split_component([at.get((p, d - 1), -1) for p, d in zip(parent, depth)], rows[a:b, 5:])
        return np.column_stack([rows[:, 3], rows[:, 2], sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, len(columns)), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.column_stack([batch.column(c).fill_null(-1).to_numpy() for c in columns])])
            if not len(rows):
                continue
            cut = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0])
            rest = rows[cut:]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in solve(rows[:cut]).T], names)
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in solve(rest).T], names)

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def rollup(nodes: DataFrame, prefixes: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """(owner, depth, values): sums over subtrees, by centroid decomposition.

    ``nodes`` has owner, depth, parent, mass and the long ``values``;
    ``prefixes`` has owner and parent of every (conv, depth).
    """
    tops = ["top_owner", "top_depth"]
    cells = ["owner", "depth", "parent", "mass", *values]
    root = nodes.agg(F.min("owner").alias("top_owner"), F.min("depth").alias("top_depth"))  # one row
    now = nodes.select(*cells).crossJoin(F.broadcast(root))
    found: list[DataFrame] = []
    while True:
        now = staged(now, "components")
        sizes = now.groupBy(*tops).agg(F.count(F.lit(1)).alias("nodes"), F.max("mass").alias("total"))
        # components of more than task_nodes nodes: as many at most as nodes / task_nodes
        large = staged(sizes.filter(F.col("nodes") > task_nodes), "large")
        if large.isEmpty():
            found.append(_within_tasks(now, values))
            break
        found.append(_within_tasks(now.join(large, tops, "left_anti"), values))
        split = now.join(large, tops)
        half = split.filter(2 * F.col("mass") >= F.col("total"))
        best = half.groupBy(*tops).agg(F.max(F.struct("depth", "owner", "mass")).alias("c"))
        centroids = staged(best.select(*tops, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.mass").alias("c_mass")), "centroids")
        split = split.drop("nodes", "total").join(centroids, tops)
        child = prefixes.select(F.col("conv").alias("owner"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("child"), F.col("parent").alias("child_parent"))
        lower = split.filter(F.col("depth") > F.col("c_depth"))
        looked = lower.join(child, ["owner", "c_depth"], "left").withColumn("under", F.col("child_parent") == F.col("c_owner"))
        rest = split.filter(F.col("depth") <= F.col("c_depth")).withColumn("under", F.lit(False)).withColumn("child", F.lit(None).cast("long"))
        split = staged(looked.drop("child_parent").unionByName(rest), "split")
        is_c = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        totals = split.filter(F.col("under") | is_c).groupBy("c_owner", "c_depth").agg(*(F.sum(v).alias(v) for v in values))
        up = prefixes.select(F.col("conv").alias("c_owner"), F.col("depth"), F.col("owner"))
        way = centroids.join(up, "c_owner").filter(F.col("depth").between(F.col("top_depth"), F.col("c_depth")))
        way = staged(way.select("owner", "depth", "c_owner", "c_depth", "c_mass"), "ways")
        found.append(way.join(totals, ["c_owner", "c_depth"]).select("owner", "depth", *values))
        left = split.filter(~is_c).withColumn("top_owner", F.when(F.col("under"), F.col("child")).otherwise(F.col("top_owner")))
        left = left.withColumn("top_depth", F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")))
        less = way.groupBy("owner", "depth").agg(F.sum("c_mass").alias("c_mass"))
        left = left.drop("c_mass").join(less, ["owner", "depth"], "left")
        now = left.select(*tops, "owner", "depth", "parent", (F.col("mass") - F.coalesce("c_mass", F.lit(0))).alias("mass"), *values)
    every = found[0].select("owner", "depth", *values)
    for more in found[1:]:
        every = every.unionByName(more.select("owner", "depth", *values))
    return every.groupBy("owner", "depth").agg(*(F.sum(v).alias(v) for v in values))


def op13_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def prefix_trie(turns: DataFrame, block: int = BLOCK, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], ["conv", "digest", "bytes"])
    prefixes = members(rebuilt(placed), block)
    nodes = trie(prefixes).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = staged(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    sums = rollup(nodes, prefixes, ["n_leaves", "saved_tokens"], task_nodes)
    ends = ids_digest(prefixes.filter("depth = size"), ["owner", "depth"], "conv", "ends_sha256")
    both = nodes.drop("n_leaves", "saved_tokens", "mass", "bytes").join(sums, ["owner", "depth"]).join(ends, ["owner", "depth"], "left")
    return both.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


OP13_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM own, crc GROUP BY conv_id, tab
), plan AS (
  SELECT s.*, least(s.h, coalesce(b.own, 0)) AS k FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base
), turns AS (
  SELECT p.conv_id, o.place AS depth, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.base AND o.place <= p.k
  UNION ALL SELECT p.conv_id, o.place - p.h + p.k, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.place > p.h
  UNION ALL SELECT conv_id, 0, '', '' FROM plan
), named AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, max(depth) OVER (PARTITION BY conv_id) AS size,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns
), owned AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, name) AS owner FROM named
), members AS (SELECT *, lag(owner) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM owned
), nodes AS (
  SELECT owner, depth, max(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends FROM members GROUP BY owner, depth
), children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent, depth
), full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.owner = n.owner AND c.depth = n.depth
), sums AS (
  SELECT m.owner, m.depth, sum(n.saved) AS saved, count(*) FILTER (n.n_children = 0) AS leaves
  FROM full_nodes n JOIN members m ON m.conv_id = n.owner AND m.depth <= n.depth GROUP BY m.owner, m.depth
)
SELECT n.owner AS conv_id, n.depth, n.parent AS parent_conv_id, n.n_convs, n.n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s ON s.owner = n.owner AND s.depth = n.depth
"""
