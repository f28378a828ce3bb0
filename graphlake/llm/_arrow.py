"""Bounded memory for functions over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes and rows of a batch that Spark hands to a Python worker (Spark's own defaults are 64 MB and 10,000).
BATCH_BYTES, BATCH_ROWS = "8m", "2000"


#: What modules keep in a worker between tasks, by name: functions that let go of it.
HELD: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Return freed memory to the system: workers live on after a task, side by side with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def _begin(keeps: str) -> None:
    """In a worker, and by reference to its own module: let go of what other kinds of tasks have left."""
    for name, let_go in HELD.items():
        if name != keeps:
            let_go()
    _give_back()


def frugal(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back now and then and at its end. ``keeps``: what it shares
    with other tasks of its kind; what other kinds have left in the worker goes first."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        def watched() -> Iterator:
            for i, batch in enumerate(batches):
                if i % 8 == 7:
                    _give_back()
                yield batch

        _begin(keeps)
        try:
            yield from run(watched())
        finally:
            _give_back()

    return wrapped


def map_batches(df, run: Callable[[Iterator], Iterator], schema: str, keeps: str = ""):
    """``df.mapInArrow`` with small batches and frugal workers."""
    spark: SparkSession = df.sparkSession
    for key, value, default in (("maxBytesPerBatch", BATCH_BYTES, ("67108864", "67108864b", "64m")), ("maxRecordsPerBatch", BATCH_ROWS, ("10000",))):
        key = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(key)).lower() in default:  # a user's own setting stays
            spark.conf.set(key, value)
    return df.mapInArrow(frugal(run, keeps), schema)
