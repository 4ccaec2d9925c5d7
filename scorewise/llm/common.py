"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewise.session import checkpoint_dir, ship_package

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fs_path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _drop_root(spark: SparkSession, path: str) -> None:
    try:
        fs, jpath = _fs_path(spark, path)
        fs.delete(jpath, True)
    except Exception:  # the session may have ended first  # noqa: BLE001
        return


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_drop_root, spark, _ROOTS[app])
    return _ROOTS[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs the tasks of the
    current job only.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of data frames that nobody holds any more."""
    gc.collect()
    time.sleep(0.05)  # the JVM hears of dropped data frames from another thread
    spark.sparkContext._jvm.System.gc()


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_uid(docs: DataFrame, uid: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and ``uid``: one number per document, in order of the ids.

    With unique ids that are whole numbers the uid is the id.  Ids of other
    types are ranked in their order.  Rows that share an id, or have none, are
    told apart by their text: (id, text) pairs are ranked, null ids first, and
    equal pairs are one document.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        odd = docs.groupBy(F.col(id_col).alias("id")).count().filter("id is null or count > 1")
        if odd.isEmpty():
            return docs.withColumn(uid, F.col(id_col).cast("long"))
    mark, rid, rmark = (free_name(n, [*docs.columns, uid]) for n in ("_mark", "_rid", "_rmark"))
    text = F.col(text_col)
    keyed = docs.withColumn(mark, F.concat(F.when(text.isNull(), "0").otherwise("1"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))
    pairs = keyed.select(F.col(id_col).alias(rid), F.col(mark).alias(rmark)).distinct()
    ids = _ranked(pairs, [F.col(rid).asc_nulls_first(), F.col(rmark)], uid)
    hit = keyed[id_col].eqNullSafe(ids[rid]) & (keyed[mark] == ids[rmark])
    return keyed.join(ids, hit).select(*docs.columns, uid)


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Distinct ``rows`` and their rank from 0: a range sort, written once, and a count for each of its partitions."""
    part, n, at = (free_name(c, [*rows.columns, name]) for c in ("_part", "_n", "_at"))
    placed = staged(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "uids")
    placed = placed.withColumn(part, F.shiftright(at, 33))  # the partition stands above the row's 33 bits
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = sizes.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(n))  # a row for each partition
    rank = F.col(n) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, part).select(*rows.columns, rank.alias(name))


def with_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (uid, id, text); see ``add_uid``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return add_uid(base, "uid", "id", "text").select("uid", "id", "text")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column``, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def list_pieces(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` elements of a list column, one row at least."""
    sizes = batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets, lo = offsets_of(sizes), 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1 of all i, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
