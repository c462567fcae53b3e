"""Arrow-batch helpers for the operators whose inner step is Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame

from minpair.operators.scorer import ship_package

#: Rows of a batch that holds whole texts.
TEXT_ROWS = 1000


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` with this package on the workers and text-sized batches."""
    spark = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Hand freed memory back: workers are reused, and what a task before had at its peak adds up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def text_slices(b: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into slices of about ``max_bytes`` of a string column (a longer text stands alone)."""
    sizes = [x or 0 for x in pa.compute.binary_length(b.column(column)).to_pylist()]
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > max_bytes:
            yield b.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < b.num_rows:
        yield b.slice(lo)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows`` (for short rows and vectorised work)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
