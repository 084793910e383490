"""Helpers that every operator of the subpackage uses: the shared folder, written tables, sizes.

An operator returns a plan that still reads what it has written on the way, so it cannot delete that itself. Who has
consumed the result can: whatever is written inside a :func:`scratch` block is deleted at its end.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_kept: dict = {}
#: The C library's call that gives free memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
#: Row groups of written tables: what a writing task holds, and what can be read apart.
ROW_GROUP_BYTES = 16 << 20


def kept_by_worker(key, make):
    """What a worker has made for this key, kept for its next tasks; one thing at a time, so that caches do not add up.

    Memory that earlier tasks have freed goes back to the system, as workers live on.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    return _kept[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemill-")
            spark.sparkContext.setCheckpointDir(_own[app])
        found = _own[app]
    return found.rstrip("/")


def lean_batches(spark: SparkSession) -> None:
    """Batches of 1,024 rows or 8 MB between Spark and Python: texts are long, and a batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end, also after an error, the tables that this thread's :func:`written` calls made in it, but those of inner blocks that are gone."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and a lost executor loses nothing that was written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table of :func:`written` that no later step reads."""
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    ours = make(f"{shared_dir(spark)}/tidemill").toUri().getPath() + "/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = make(path)
        if target.toUri().getPath().startswith(ours):
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def splits(df: DataFrame) -> int:
    """The partitions of a plan; where shuffles decide, those that are configured, as asking would run them."""
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, df.rdd.getNumPartitions())


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: for a scan the size of its files; for rows and joins, of which it says too much, what their partitions hold at most.

    Only numbers of buckets depend on it, never a result.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, estimate if estimate < 1 << 28 else min(estimate, splits(df) << 28))


def at_least(least: int, size: float, each: float) -> int:
    """How many buckets of about ``each`` hold ``size``, ``least`` or more."""
    return max(least, int(-(-size // each)))


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """``df`` over as many tasks as there are cores, ``most`` at most, where its splits are fewer: a file of one row group is one task.

    Rows are dealt out in turn, whatever they hold. An input with a split for each core is left as it is.
    """
    want = min(most, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if splits(df) < want else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
