"""Memory of the Python workers, which Spark keeps for the tasks that follow."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch where the session sets no other bound.
BATCH = "8m"
#: Groups of fewer bytes leave so little that it is not worth looking for.
SMALL = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Python tasks take at most ``BATCH`` at once, on both sides of the pipe, unless the session sets a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH)


def give_back() -> None:
    """Return freed memory to the machine: Arrow's pool and the C library's heap else keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving memory back after each batch and at its end; same rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        give_back()

    return task


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for ``applyInArrow``, giving memory back after each group that is not small; same rows."""

    def group(table: pa.Table) -> pa.Table:
        size = table.nbytes
        out = run(table)
        if size > SMALL:
            give_back()
        return out

    return group
