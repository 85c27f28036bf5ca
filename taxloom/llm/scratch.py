"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="taxloom-")


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; only a session of one machine (a test) that names none gets a folder there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _own_folder()
    return f"{base.rstrip('/')}/taxloom-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs that run within have these settings; afterwards the session is as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Rows go to Python in batches of so many bytes: a worker holds a few whole texts, not a partition of them.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@functools.cache
def _trim() -> Callable[[], None]:
    """Hands freed memory of this process back to its machine, where the C library can."""
    import pyarrow as pa

    try:
        give = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        give = int
    return lambda: (pa.default_memory_pool().release_unused(), give(0))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same mapInArrow function, in a worker that keeps no memory of batches that are done: workers live on through the stages of a job."""

    def trimmed(batches: Iterator) -> Iterator:
        for i, batch in enumerate(batches):
            yield batch
            del batch
            if i % 8 == 7:  # each time costs as much as a few hundred lines
                _trim()()

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(trimmed(batches))
        _trim()()

    return wrapped


def settle(df: DataFrame, **options: str) -> DataFrame:
    """The same rows read back from a table in the shared folder, written with these options; a lost executor costs only a re-read."""
    spark = df.sparkSession
    at = folder(spark)
    with settings(spark, BATCHES):
        df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(*settled: DataFrame) -> None:
    """Removes tables of settle() that no later job reads."""
    for df in settled:
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own Bloom filters of a join's smaller side, of 8 MB at most, on inputs of any size.
FILTERS = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "256MB"}.items()}


def runtime_filters(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Jobs that run within may drop rows of a join's larger side before its shuffle, if a Bloom filter says that they meet none."""
    return settings(spark, FILTERS)


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 500_000


def small_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with small, a settled table of a few numbers a row: it's broadcast if its rows are counted as BROADCAST_ROWS or fewer, else both are shuffled by key."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, how)


def hub_join(big: DataFrame, small: DataFrame, key: str, rows: str | None = None, least: int = 512, most: int = 100_000) -> DataFrame:
    """Inner join of big, a settled table, with small, which has a row for each key.

    Keys with over least rows of big, and over one row in `most` of it, can't be more than `most`: their rows of small are
    broadcast, so that no task gets a hub's rows of big. All other rows are shuffled by key. rows: a column of small with the number of big's rows, if known.
    """
    limit = max(least, big.count() // most)
    hubs = small.where(F.col(rows) > limit) if rows else small.join(big.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit), key).drop("_n")
    return big.join(F.broadcast(hubs.select(key)), key, "left_anti").join(small, key).unionByName(big.join(F.broadcast(hubs), key))
