"""Small helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, written

__all__ = ["LOWER", "UPPER", "WORD", "arrow_rows", "bound_batches", "lean", "let", "lower_ascii", "partitions", "plan_bytes", "scratch", "trim", "written"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches to Python hold at most so many rows: bounds memory where rows are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For steps that run only when their result is read: lower the session's Arrow batches to ``rows``.

    A batch of Spark's default 10,000 long texts takes a worker and its executor hundreds of megabytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give memory that nothing uses back to the system: Python workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run``, a function for mapInArrow, leaving a lean worker behind."""

    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


def plan_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as the planner estimates them, 0 where it cannot. Decides how finely work is dealt, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
