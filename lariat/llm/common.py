"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

U64 = np.uint64
#: Rows of an Arrow batch; with texts of 100 kB a batch stays near 25 MB.
BATCH_ROWS = 256
#: Rows of numbers in an Arrow batch that goes back to Spark.
SLICE = 1 << 15


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that hold whole texts, and let workers import this package from the driver's folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset in local mode, as in tests."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "lariat-shared")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/lariat-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lariat_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these; no plan that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "_lariat_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, Python's and the JVM's.

    Spark drops a shuffle's files and a broadcast's blocks only when the driver has collected what stood for them, and
    its JVM gives heap back only then. An operator that plans very many short jobs calls this now and then.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole_ids(df: DataFrame, column: str) -> Column:
    """The id column as a long; other types than whole numbers are refused, as a cast would merge or lose ids."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")
    return F.col(column).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Gapless numbers from 0 within each key, without gathering a key's rows in one task.

    The rows are written with the number of the partition that made them; a group is then (key, partition),
    which no hot key can make larger than one partition, and the groups' sizes give each its first number.
    The counts are keyed rows, never collected. Which rows get which numbers depends on the input's partitions.
    """
    kept = materialize(df.withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = kept.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    return local.join(starts, [*keys, "_part"]).withColumn(rank, F.col("_start") + F.col("_local")).drop("_start", "_local", "_part")


def id_filter(ids: DataFrame, column: str):
    """A column function that is true for every id of ``ids`` and, by chance, for a few others.

    A set of hash positions goes out with the function, about eight for each id, 8 kB to 32 MB. It spares a shuffle the
    rows that surely aren't meant; an exact join decides about the others, of which there are more beyond some 100
    million ids. ids is read twice.
    """
    bits = min(28, max(16, (8 * ids.count()).bit_length()))
    rows = ids.select((F.shiftrightunsigned(F.xxhash64(column), 64 - bits)).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    table = ids.sparkSession.sparkContext.broadcast(table.view(U64))

    @F.arrow_udf("boolean")
    def maybe(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False).astype(np.int64).view(U64) >> U64(64 - bits)
        return pa.array((table.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool))

    return lambda name: maybe(F.xxhash64(name))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of SLICE rows, as the JVM holds each whole outside its heap; none of an empty one."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def map_batches(df: DataFrame, fn, schema: StructType | str) -> DataFrame:
    """mapInArrow with fn(batch) -> batch or None."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield from sliced(out)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BASE, _STEP = 0x5851F42D4C957F2D, 0xDA942042E4DD58B5
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWERED = _TABLE.copy()
_LOWERED[65:91] = _TABLE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in runs of whole words of at most so many bytes, whose powers are held; a longer word is a run by itself.
SPAN = 1 << 16
_UP, _DOWN = _powers(_BASE, SPAN), _powers(_INVERSE, SPAN)


def word_hashes(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words [^\\x20\\x09-\\x0D]+ of one text; lower folds A-Z.

    A word's hash is a polynomial over random byte values modulo 2**64, then mixed; all of it by prefix sums.
    """
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_BLANK[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values = _LOWERED if lower else _TABLE
    out = np.zeros(len(start), U64)
    first = 0
    while first < len(start):
        at = start[first]
        last = max(first + 1, int(np.searchsorted(end, at + SPAN, "right")))
        n = int(end[last - 1] - at)
        up, down = (_UP[:n], _DOWN) if n <= SPAN else (_powers(_BASE, n), _DOWN)
        total = np.zeros(n + 1, U64)
        np.cumsum(values[raw[at : at + n]] * up, out=total[1:])
        s, e = start[first:last] - at, end[first:last] - at
        out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mix(out + (end - start).astype(U64)), start, end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of the whole sequence, if it has fewer words; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, U64)
    for i in range(width):
        out = out * U64(_STEP) + words[i : n - width + 1 + i]
    return mix(out)
