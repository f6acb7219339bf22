"""Vector functions as Column expressions, and the same kernels on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a, b) -> Column:
    """Sum of squared differences, accumulated in double; no square root."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y))


def norm2(a) -> Column:
    return dot(a, a)


def add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def scale(a, by) -> Column:
    return F.transform(_col(a), lambda x: x * by)


def permute(a, order: list[int]) -> Column:
    """The components of a in the order of their positions; permute(_, inverse(order)) undoes it."""
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.element_at(_col(a), i + 1))


def inverse(order: list[int]) -> list[int]:
    return [int(x) for x in np.argsort(order)]


def register(spark: SparkSession) -> None:
    """squared_l2, dot and norm2 for SQL, as expressions without Python."""
    arrays = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION squared_l2({arrays}) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot({arrays}) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm2(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)")


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles, without a Python object for each row."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not len(lists):
        return np.zeros((0, dim or 0))
    if len(flat) % len(lists) or (dim is not None and len(flat) != dim * len(lists)):
        raise ValueError("vectors of different dimensions")
    return flat.reshape(len(lists), -1)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.einsum("ij,ij->i", d, d)


def summed(rows: np.ndarray, points: np.ndarray, term) -> np.ndarray:
    """For each point and row the sum of term(x, y) over the components, left to right as the expressions above add: the same doubles."""
    columns, out = np.ascontiguousarray(rows.T), np.zeros((len(points), len(rows)))
    for i, x in enumerate(columns):
        out += term(x, points[:, i : i + 1])
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, without negative zeros; what has no such digits (large, infinite, NaN) stays."""
    y = x * 10.0**digits
    return np.where(np.abs(y) < 2.0**52, np.trunc(y + np.copysign(0.5, y)) / 10.0**digits, x) + 0.0
