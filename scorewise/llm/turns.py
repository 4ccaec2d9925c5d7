"""Places of rows inside groups of any size, without a window over a group.

The rows are dealt by ranges of (group, order), so a group that holds a third
of all rows lies in a third of all tasks.  A task counts on from the start of
the group in its own range; only a range's first group can have begun before
it, so the rest is one number for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewise.llm.common import staged


def same_as_before(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value equals the one before it (nulls are equal); ``before`` comes before the first."""
    n = len(column)
    out = np.zeros(n, bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        equal = pc.or_(pc.equal(a, b).fill_null(False), pc.and_(a.is_null(), b.is_null()))
        out[1:] = equal.to_numpy(zero_copy_only=False)
    if n and before is not None:
        out[0] = before.as_py() == column[0].as_py()
    return out


def numbered(rows: DataFrame, group: str, order: list[Column], keep: list[str], name: str = "place") -> DataFrame:
    """The ``keep`` columns of ``rows`` and each row's place in its group, from 0; written to the shared folder.

    ``group`` is among ``keep``.  Rows that are equal in group and order stand in any order.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the last key tells equal rows apart, so that very many of them can be split as well
    by = [F.col(group).asc_nulls_first(), *order, F.col("_tie").asc()]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
    dealt = dealt.sortWithinPartitions(*by).select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, at, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(group)
            new = ~same_as_before(column, last)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.where(start < 0, np.arange(n) + at, np.arange(n) - start)
            opens = np.cumsum(new) - (last is None) if first else np.ones(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(opens <= 0)], [*keep, "_part", "_place", "_lead"]
            )
            last, at, first = column[n - 1], int(place[-1]) + 1, first and bool(opens[-1] <= 0)

    added = [T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField("_lead", T.BooleanType())]
    schema = T.StructType([*dealt.schema, *added])
    local = staged(dealt.mapInArrow(run, schema), "placed")
    runs = local.groupBy(F.col(group).alias("_g"), "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_lead").alias("_lead"))
    # a range has one leading group: so many rows at most as there are ranges
    led = F.broadcast(runs.filter("_lead").select(F.col("_g").alias("_led")).distinct())
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.join(led, F.col("_g").eqNullSafe(F.col("_led")), "left_semi").withColumn("_before", before).filter("_lead").select("_part", "_before")
    full = local.join(F.broadcast(offsets), "_part", "left")
    place = F.col("_place") + F.when(F.col("_lead"), F.coalesce("_before", F.lit(0))).otherwise(0)
    return full.select(*keep, place.alias(name))
