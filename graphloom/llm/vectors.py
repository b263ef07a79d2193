"""Helpers for tables of vectors: packing rows into numpy blocks, and the rotation onto principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim doubles, valid) of a column of lists; short rows are filled with zeros.

    A row is valid if it is a list whose components are all finite numbers. Others hold zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    dim = int(max(n, default=0)) if dim is None else dim
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    ok = np.isfinite(out).all(axis=1) & ~np.asarray(column.is_null())
    out[~ok] = 0
    return out, ok


def dimension(df: DataFrame, column: str) -> int:
    """The length of the longest list in a column (0 without rows)."""
    from pyspark.sql import functions as F

    return df.agg(F.max(F.size(column))).first()[0] or 0


def rotation(df: DataFrame, column: str, dim: int, transform=None) -> np.ndarray:
    """Principal axes, by falling variance about 0, of all vectors: the right singular vectors of the table.

    Every partition sends one dim x dim matrix of sums; partitions are merged in steps, so neither
    a task nor the driver gathers more than a fixed number of them.
    """
    kind = "part int, gram binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dim, dim))
        for b in batches:
            x, ok = matrix(b.column(0), dim)
            x = x if transform is None else transform(x)
            total += x[ok].T @ x[ok]
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "gram": pa.array([total.tobytes()])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for raw in b.column(1).to_pylist():
                total += np.frombuffer(raw).reshape(dim, dim)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "gram": pa.array([total.tobytes()])})

    sums = df.select(column).mapInArrow(local, kind)
    merged = sums.repartition(16, "part").mapInArrow(add, kind).collect()
    total = sum((np.frombuffer(r.gram).reshape(dim, dim) for r in merged), np.zeros((dim, dim)))
    scale = np.abs(total).max()
    values, axes = np.linalg.eigh(total / scale if np.isfinite(scale) and scale > 0 else np.eye(dim))
    return axes[:, np.argsort(-values)]
