"""Sharding: a uniform random order of all rows in shards of exact sizes.

The communication matrix of a uniform shuffle has a known law: how many rows
go from each partition to each shard follows the multivariate hypergeometric
distribution.  It is drawn in two steps from row counts alone.  The driver
draws the matrix (block of partitions x shard); there are about as many blocks
as a block has partitions, so both are near the square root of the partitions.
A task per block then deals its line of that matrix to the block's partitions.
Given a block's line, the block's rows are again shuffled uniformly, so the
two steps give the law of one.  After that each partition permutes its rows
and cuts them by its line, the rows are exchanged by shard, and each shard
permutes what it got.  Shard sizes are exact by construction, and differ by
one row at most.

The permutations sort by a hash of (seed, partition, row), so retried tasks
give the same rows.  The rows' partition and place are written first; no later
step depends on how files are split when they are read.  Places in a shard are
counted in cells of a shard (ranges of the sort key), so no task holds a shard.
The plan is one and the same at every size.

Defined results: null texts have no bytes; equal rows, equal or null ids are
rows like all others; equal texts are placed apart from each other at random.
An empty table gives no rows.  Rows that have a column ``shard`` or ``slot``
(in any case) keep it; the new columns then take underscores before their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewise.llm.common import free_name, staged, table

#: Rows of a cell, about: the rows that one task permutes at once.
CELL_ROWS = 500_000


def shard_sizes(total: int, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Sizes that differ by one at most; which shards are larger is drawn."""
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    rng.shuffle(room)
    return room


def draw_matrix(rows: list[int], room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Row counts [part, shard] of a uniform shuffle of parts of these sizes into shards with this room."""
    room = room.copy()
    out = np.zeros((len(rows), len(room)), np.int64)
    for p, n in enumerate(rows):
        left, rest = n, int(room.sum())
        for s in range(len(room)):  # a line's entries one after another, each given those before it
            rest -= int(room[s])
            out[p, s] = _hypergeometric(rng, int(room[s]), rest, left)
            left -= int(out[p, s])
        room -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:  # numpy's limit
        return int(rng.hypergeometric(good, bad, draws))
    first, mass = _masses(good, bad, draws)
    return first + min(int(np.searchsorted(np.cumsum(mass), rng.random(), side="right")), len(mass) - 1)


def _masses(good: int, bad: int, draws: int) -> tuple[int, np.ndarray]:
    """The hypergeometric law around its mode: the first value, and the probabilities from there on.

    Ratios of neighbouring probabilities are p(k+1)/p(k) = 1 + u(k)/v(k) with a
    linear u, so their logarithms lose no digits however large the numbers are.
    They are summed outwards from the mode until nothing is left that a double
    between 0 and 1 could meet (e^-60), and divided by their sum.
    """
    total = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), lo), hi)
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5

    def side(step: int, limit: int) -> np.ndarray:
        """Logarithms of p(mode + step * j) / p(mode) for j = 1, 2, .. limit, as far as they count."""
        logs, at, last = [], 0, 0.0
        block = int(4 * spread) + 64
        while at < limit and last > -60:
            j = np.arange(at, min(at + block, limit), dtype=np.float64)
            # from k to k + 1; going down, from k - 1 to k and the ratio is turned over
            base = mode if step > 0 else mode - 1
            over = float((good - base) * (draws - base) - (base + 1) * (bad - draws + base + 1)) - step * j * float(total + 2)
            under = (base + 1 + step * j) * (float(bad - draws + base + 1) + step * j)
            run = last + np.cumsum(step * np.log1p(over / under))
            logs.append(run)
            at, last = at + len(j), float(run[-1])
        return np.concatenate(logs) if logs else np.zeros(0)

    down, up = side(-1, mode - lo), side(1, hi - mode)
    mass = np.exp(np.concatenate([down[::-1], [0.0], up]))
    return mode - len(down), mass / mass.sum()


def _dealt(counts: DataFrame, blocks: int, shards: int, seed: int, cut: str) -> DataFrame:
    """(part, cut): for each partition how many of its rows go to the shards up to each one."""
    block = F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int")
    counts = counts.select("part", "n", block.alias("block"))
    sizes = sorted((r["block"], r["n"]) for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect())
    rng = np.random.Generator(np.random.Philox(seed))
    rows = [n for _, n in sizes]
    lines = draw_matrix(rows, shard_sizes(sum(rows), shards, rng), rng).tolist()
    rooms = counts.sparkSession.createDataFrame([(b, line) for (b, _), line in zip(sizes, lines)], "block int, room array<long>")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, room, parts, ns in zip(frame["block"], frame["room"], frame["parts"], frame["ns"]):
                own = np.random.Generator(np.random.Philox(key=[seed, int(number) + 1]))
                drawn = draw_matrix([int(n) for n in ns], np.asarray(room, np.int64), own)
                yield pd.DataFrame({"part": np.asarray(parts), cut: list(np.cumsum(drawn, axis=1))})

    listed = counts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("of"))
    lists = listed.select("block", F.col("of.part").alias("parts"), F.col("of.n").alias("ns"))
    return lists.join(rooms, "block").mapInPandas(deal, f"part int, `{cut}` array<long>")


def uniform_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rows`` and (shard int, slot long): uniformly shuffled, slots gapless from 0 in each shard."""
    taken = list(rows.columns)

    def name(wanted: str) -> str:
        taken.append(free_name(wanted, taken))
        return taken[-1]

    part, seq, cut, shard, slot, key, cell, n = map(name, ("_part", "_seq", "_cut", "shard", "slot", "_key", "_cell", "_n"))
    kept = staged(rows.withColumn(part, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id()), "shard-rows")
    counts = staged(kept.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    parts, total = counts.agg(F.count("part"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, round(parts**0.5))
    cuts = staged(_dealt(counts, blocks, shards, seed, cut).withColumnRenamed("part", part), "shard-cuts")
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), F.lit("out"), part, seq), seq)
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    sent = (
        kept.withColumn(key, F.row_number().over(local).cast("long"))
        .join(cuts, part)
        .withColumn(shard, F.size(F.filter(cut, lambda c: c < F.col(key))))
        .drop(cut, key)
        .withColumn(key, F.xxhash64(F.lit(seed), F.lit("in"), part, seq))
        .withColumn(cell, F.pmod(F.shiftrightunsigned(key, 16), F.lit(cells)).cast("int"))
    )
    sent = staged(sent, "shard-sent")
    sizes = sent.groupBy(shard, cell).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(shard).orderBy(cell)) - F.col(n)
    sent = sent.join(sizes.select(shard, cell, before.alias(cut)), [shard, cell])
    inside = Window.partitionBy(shard, cell).orderBy(key, part, seq)
    placed = sent.withColumn(slot, F.col(cut) + F.row_number().over(inside) - 1)
    return placed.select(*rows.columns, F.col(shard).cast("int"), F.col(slot).cast("long"))


def op5_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return uniform_shards(rows, 40, seed=11).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
