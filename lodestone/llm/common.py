"""Shared plumbing of the training-data operators: scratch tables, id filters and sorted-group iteration."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Bits of the membership filter of :func:`only_ids`; 2**25 bits make 1,024 rows of 4 KB, 4 MB whatever the input.
FILTER_BITS = 1 << 25
#: Bytes of one Arrow batch between the JVM and Python, unless the session says otherwise.
BATCH_BYTES = "4m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "67108864b", "67108864")
#: Shuffle files go at the end of the query that made them.
_CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two calls of :func:`trim_driver` that do something.
TRIM_SECONDS = 2.0
_trimmed = float("-inf")
#: Bits of one row that ``bitmap_construct_agg`` builds.
BITMAP_ROW = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only on a local master without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"lodestone-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts cost an executor little memory beside its heap."""
    if spark.conf.get(_BATCH_SETTING, None) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here, and lost executors lose nothing.

    The files go when the driver's JVM ends, or by :func:`dropped`; the shuffles of the write go at its end, as the driver
    frees them only when its own heap is short, which it may never be.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SETTING, None)
    spark.conf.set(_CLEAN_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_SETTING) if before is None else spark.conf.set(_CLEAN_SETTING, before)
    trim_driver(spark)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables of :func:`stored` that nothing reads any more."""
    for rows in tables:
        context = rows.sparkSession.sparkContext
        for path in {os.path.dirname(f) for f in rows.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def trim_driver(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed of its native heap.

    Planning and broadcasts run on hundreds of short-lived threads, whose allocator keeps what they free (measured: 213 of
    1,139 MB in the middle of the pipeline).  JVMs without the command are left as they are.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_SECONDS:
        return
    _trimmed = time.monotonic()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):
        none, kind, call = (gateway.new_array(c, n) for c, n in ((jvm.java.lang.Object, 1), (jvm.java.lang.String, 1), (jvm.java.lang.Object, 4)))
        none[0], kind[0] = gateway.new_array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        call[0], call[1], call[2], call[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", none, kind
        # by reflection on the interface, as the server's own class is not open to callers
        method = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)


def give_back() -> None:
    """Return freed memory of numpy and Arrow to the system after work on the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def held(df: DataFrame) -> DataFrame:
    """Keep a small table that is read several times on the executors' disks.  Its lineage stays: what a lost executor
    held is computed again."""
    small_batches(df.sparkSession)
    return df.persist(StorageLevel.DISK_ONLY)


def flagged(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is not in the one column of ``ids`` (null keys: false).

    A bitmap of fixed size is broadcast, never the ids.
    """
    (id_col,) = ids.columns
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    bits = (
        ids.select(bit(id_col).alias("_h"))
        .groupBy((F.col("_h") / BITMAP_ROW).cast("int").alias("_row_of"))
        .agg(F.expr(f"bitmap_construct_agg(_h % {BITMAP_ROW})").alias("_map"))
    )
    names = [F.col(c) for c in rows.columns]
    spread = rows.withColumn("_h", bit(key)).withColumn("_row_of", (F.col("_h") / BITMAP_ROW).cast("int"))
    byte = F.expr(f"cast(conv(hex(substring(_map, cast((_h % {BITMAP_ROW}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.expr("cast(_h % 8 as int)")
    set_ = F.coalesce(F.col(key).isNotNull() & F.expr("(shiftright(_byte, _bit) & 1) = 1"), F.lit(False))
    return spread.join(F.broadcast(bits), "_row_of", "left").withColumn("_byte", byte).withColumn("_bit", hit).select(*names, set_.alias("_maybe"))


def only_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` is probably in ``ids`` (no false negatives); a join after this one is exact and shuffles few."""
    return flagged(rows, key, ids).where("_maybe").drop("_maybe")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` so that no group is cut; tables hold at least ``least`` rows but the last."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = rows - 1
        same = np.ones(rows, dtype=bool)
        for key in keys:
            column = whole.column(key).to_numpy()
            same &= column == column[last]
        different = np.flatnonzero(~same)
        if not len(different):
            continue
        cut = int(different[-1]) + 1
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
