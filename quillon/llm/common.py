"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import materialize, ship
from quillon.session import table as read_table

__all__ = ["WORD", "bound", "discard", "forget", "frugal", "held", "in_blocks", "materialize", "range_index", "read_table", "running", "sweep"]

#: ASCII white space that separates words; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


#: The model that this Python worker holds, by key; one at most.
_HELD: dict = {}


def held(key: tuple, build: Callable):
    """What ``build()`` gave for ``key``, made once in a Python worker; the model before it goes first, so that two never stand in memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def forget() -> None:
    """Drop the model of this Python worker."""
    _HELD.clear()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000, holds: bool = False) -> Callable:
    """A mapper over Arrow batches that sees at most ``rows`` rows at once and returns memory when its task ends.

    Python workers live on between tasks and stages; what the allocators keep would add up in an executor.
    A model that an earlier stage left goes too, unless the mapper ``holds`` one itself.  Workers need
    this package, so it is shipped here if it was not yet.
    """
    ship(SparkSession.active())

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            forget()
        try:
            yield from run(sliced(batches))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass

    return wrapped


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: it does so once the driver's JVM has collected their plans, which a long job may not see for an hour."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; they would stay until the driver ends."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for df in tables[:1]:
        sweep(df.sparkSession)


def range_index(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted ``splitters``, given as SQL literals, are <= ``key``: a two-level search, about 2*sqrt(n) comparisons."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    width = max(1, math.isqrt(n))
    blocks = [splitters[i : i + width] for i in range(0, n, width)]
    array = lambda items: f"array({', '.join(items)})"  # noqa: E731  parsed at once, which is much faster than building columns
    block = F.size(F.filter(F.expr(array(b[0] for b in blocks)), lambda s: s <= key))
    inner = F.element_at(F.expr(array(array(b) for b in blocks)), block)
    return F.when(block == 0, 0).otherwise((block - 1) * width + F.size(F.filter(inner, lambda s: s <= key)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression is computed anew for every item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array cut into blocks of the square root of its size; null if it is empty."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), w), lambda at: F.slice(items, at, w))
    return F.when(F.size(items) > 0, bound(width, cut))


def running(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``emit(state, item)``, an array of ``kind``, gives for each item in turn, joined; ``step`` gives the next state.

    The items are walked in blocks of the square root of their number, as an array that grows item by
    item is copied each time.  With blocks n items cost about n * sqrt(n) copied references.
    """
    none = F.array().cast(f"array<{kind}>")
    blocks = bound(items, in_blocks)
    walked = F.aggregate(
        blocks,
        F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda done, block: F.aggregate(
            block,
            F.struct(done["state"].alias("state"), none.alias("out")),
            lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], emit(s["state"], x)).alias("out")),
            lambda s: F.struct(s["state"].alias("state"), F.concat(done["out"], F.array(s["out"])).alias("out")),
        ),
        lambda done: F.flatten(done["out"]),
    )
    return F.coalesce(walked, none)
