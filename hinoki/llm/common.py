"""Shared helpers: tables, the shared folder, text conventions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that may be broadcast; every use is behind a count, with a shuffle join beyond it.
BROADCAST_ROWS = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a
    temporary one, made once, only where the session is local and names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="hinoki-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation.  The shuffle files of the write go with it; else
    they stay until the driver happens to collect its garbage."""
    path, conf = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def plain_stages(spark: SparkSession):
    """Within it, queries run without whole-stage code.  Long rules of conjugation make some ten
    thousand lines of it a stage, more than a method may have: the driver would make, compile and
    drop them, in vain and at the cost of its memory."""
    conf, key = spark.conf, "spark.sql.codegen.wholeStage"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        yield
    finally:
        conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as make it no column of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the text ''."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (counted), else as it is.
    Give it a materialized or small df of narrow rows."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


SLICE = 256  # rows that a worker turns into Python objects at once
BATCH_ROWS = 512


def small_batches() -> None:
    """Arrow batches of a few whole texts: at Spark's default of 10,000 rows one batch of
    long texts can fill a worker.  A session that has its own setting keeps it."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give a worker's free memory back to the system: workers outlive their tasks, and
    the next stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


def frugal(f):
    """A function of Arrow batches that gets small slices of them and leaves no memory behind."""
    small_batches()

    def run(batches):
        try:
            yield from f(b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        finally:
            release()

    return run


def frugal_group(f):
    """The same for a function of a group's table."""

    def run(table):
        try:
            return f(table)
        finally:
            release()

    return run


def frugal_pair(f):
    """The same for a function of two tables of a group."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return run
