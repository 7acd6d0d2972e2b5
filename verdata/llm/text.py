"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row.

    An expression that a lambda refers to is evaluated again for each element; a lambda's own
    variable isn't.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """``op`` over each element and all before it (at least 0), of an array of longs.

    Arrays grow by copying, so long ones are gone through in chunks, which keeps the cost in proportion to the length.
    """
    empty = F.array().cast("array<bigint>")

    def within(a: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["all"], F.array(op(s["at"], x))).alias("all"))
        return F.aggregate(a, F.struct(start.cast("bigint").alias("at"), empty.alias("all")), step)["all"]

    def long_(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))
        whole = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), op)
        return let(chunks, lambda cs: let(within(F.transform(cs, whole), F.lit(0)), lambda upto: F.flatten(
            F.transform(cs, lambda c, i: within(c, F.coalesce(F.get(upto, i - 1), F.lit(0).cast("bigint")))))))

    return let(values, lambda v: F.when(F.size(v) <= chunk, within(v, F.lit(0))).otherwise(long_(v)))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII spaces, tabs and line ends, byte for byte (``bytes.split`` has just these separators)."""
    return text.split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + limit)))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
