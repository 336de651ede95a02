"""What the operators on tables of vectors share: integer vectors, their length, and sums over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stretches in which arrays of fixed size are added up, each by one task.
PARTS = 16


def finite(vector: Column) -> Column:
    """Whether a vector is there, with entries that are neither null nor infinite nor no number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(rows: DataFrame, columns: dict[str, str], vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """The rows with a finite vector as x = floor(scale * c), arrays of long, and the length of those vectors (0: no row).

    columns: the other columns wanted, by their name in the result. Rows whose vector has another length than the
    commonest one (ties to the shorter) are left out: no sum with them is defined. Entries beyond the range of a long are
    held at its ends.
    """
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    every = rows.select(*(F.col(c).alias(name) for name, c in columns.items()), v.alias("x")).where(finite(F.col("x")) & (F.size("x") > 0))
    every = every.withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))
    length = every.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (every.where(F.size("x") == length.n), length.n) if length else (every, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an array with a row for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, dtype) -> np.ndarray:
    """Sum over all tasks of the `size` numbers that partial makes of a task's rows: sums meet in PARTS tasks, and of
    these one array of that fixed size goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.astype(dtype).tobytes() for x in np.array_split(partial(batches), PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, dtype)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "sums"])

    kind = "part int, sums binary"
    out = [x.copy() for x in np.array_split(np.zeros(size, dtype), PARTS)]
    for r in rows.mapInArrow(run, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect():  # PARTS rows
        out[r["part"]] += np.frombuffer(r.sums, dtype)
    return np.concatenate(out)


LOW = np.int64((1 << 32) - 1)


def halves(x: np.ndarray) -> np.ndarray:
    """Two longs for each: sums of them cannot overflow, and whole() of the sums is the exact sum."""
    return np.stack([x >> np.int64(32), x & LOW])


def whole(sums: np.ndarray) -> np.ndarray:
    """The exact integers that sums of halves stand for, as Python integers."""
    high, low = sums.astype(object)
    return high * (1 << 32) + low


def long_or_null(values) -> pa.Array:
    """Exact integers as longs; null where one does not fit."""
    return pa.array([int(x) if -(1 << 63) <= x < 1 << 63 else None for x in values], pa.int64())
