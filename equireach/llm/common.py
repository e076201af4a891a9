"""What the text operators share: scratch tables in the cluster's shared folder, and byte-level kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Collection, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function which keeps something of every text takes at once.
BATCH_ROWS = 2000


def trim() -> None:
    """Gives memory that this worker no longer uses back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Seconds between two calls of trim_driver by Scratch, at least.
TRIM_S = 10
_trimmed = {"at": float("-inf")}


def trim_driver(spark: SparkSession) -> None:
    """Gives memory of finished queries back on the driver: garbage of its JVM, with the shuffle files and broadcasts that
    go with it, what the JVM's C library holds freed, and the same in this process."""
    trim()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    lang, management = jvm.java.lang, jvm.javax.management

    def array(kind: Any, *items: Any) -> Any:
        out = gateway.new_array(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    lang.System.gc()
    with contextlib.suppress(Exception):  # not every JVM has this command
        invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(lang.Object, array(lang.String)), array(lang.String, "[Ljava.lang.String;")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, *given))
    _trimmed["at"] = time.monotonic()


_KEPT: dict[str, tuple[Any, Any]] = {}


def kept(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What this worker made for key, and holds from task to task: the last one of its kind."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]


def let_go(uses: Collection[str] = ()) -> None:
    """Drops what this worker holds of kinds that its present task does not use: a worker goes from stage to stage."""
    others = [kind for kind in _KEPT if kind not in uses]
    for kind in others:
        del _KEPT[kind]
    if others:
        trim()


def parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, uses: Collection[str] = ()) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows; uses: the kinds of what the task holds."""
    let_go(uses)
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine), a temporary folder of this process."""
    set_there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_there:
        return set_there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    here = getattr(shared_dir, "here", None)
    if here is None:
        here = shared_dir.here = "file://" + tempfile.mkdtemp(prefix="equireach-")
    return here


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, no more than BATCH_ROWS rows travel to a Python worker at once: neither side needs buffers for more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables and files that a query writes to the shared folder to cut lineage.

    drop() removes one as soon as no later step reads it; the rest go when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and reads it back: what follows starts from files that outlive any executor."""
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        if time.monotonic() - _trimmed["at"] >= TRIM_S:
            trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(df: DataFrame) -> int:
    """A count of shuffle partitions that follows the input: that of the scan, or the session's setting if larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Words of 64 bits in a filter over ids, as powers of two: at least, and at most, whatever the number of ids.
LEAST_WORDS, MOST_WORDS = 12, 19


def words_for(ids: int) -> int:
    """The power of two of words that gives an id four bits or more, within the bounds."""
    return max(LEAST_WORDS, min(MOST_WORDS, (4 * ids // 64).bit_length()))


def maybe_among(df: DataFrame, column: str, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """df with a boolean `name`, true for every row whose column is among ids and for few others.

    A filter is broadcast, sized by a count of the ids, 2**MOST_WORDS words at most, so that rows need no shuffle to be
    told apart. Beyond some ten million ids more rows pass; what follows must not depend on it.
    """
    power = words_for(ids.count())
    h = F.xxhash64(F.col(column).cast("long"))
    one = ids.select(F.xxhash64(F.col(id_col).cast("long")).alias("_h"))
    words = one.groupBy(F.shiftrightunsigned("_h", 64 - power).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_h & 63 AS INT)))").alias("_bits"))
    met = df.withColumn("_h", h).join(F.broadcast(words), F.shiftrightunsigned("_h", 64 - power) == F.col("_word"), "left")
    there = F.expr("coalesce(_bits & shiftleft(1L, CAST(_h & 63 AS INT)), 0L) <> 0")
    return met.withColumn(name, there).drop("_h", "_word", "_bits")


def without(df: DataFrame, column: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose column is not among ids, all columns; rows with a null stay. Only rows that may be among
    them are shuffled."""
    gone = ids.select(F.col(id_col).cast("long").alias("_gone")).where("_gone IS NOT NULL").distinct()
    told = maybe_among(df, column, gone, "_gone", "_maybe")
    doubtful = told.where("_maybe").drop("_maybe")
    return told.where("NOT _maybe").drop("_maybe").unionByName(doubtful.join(gone, doubtful[column] == gone["_gone"], "left_anti"))


#: Keys that may be broadcast because so many rows have them, at most; and the rows that make a key one of them, at least.
MOST_HOT, LEAST_HOT = 10_000, 1000


def hot_from(total: int) -> int:
    """A key with more rows than this is hot: of total rows, MOST_HOT keys at most can be."""
    return max(LEAST_HOT, total // MOST_HOT)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table (inner or left), which has one row a key and in `size` how many of the `total` rows have it.

    Rows of hot keys stay where they are and meet a broadcast of their keys, MOST_HOT rows; the others are shuffled.
    """
    most = hot_from(total)
    if total <= most:
        return rows.join(table, on, how)
    hot, rest = F.broadcast(table.where(F.col(size) > most)), table.where(F.col(size) <= most)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))
