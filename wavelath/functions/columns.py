"""Columns of numbers and of vectors: literals, and numpy functions over Arrow batches.

A vector is an array<double> of one row. Pointwise work is built-in column
functions. Products with constant matrices, transforms and solvers run in numpy
on whole Arrow batches: one matrix product for all rows of a batch costs a small
part of what the same sums cost as interpreted array functions.

A null vector gives null. A null element counts as NaN. Vectors of different
lengths may stand in one column; each length is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numbers(values: Sequence[float]) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def zeros(count: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), count if isinstance(count, Column) else F.lit(count))


def whole(x: Column | str, k: int) -> Column:
    """Element k, counted from 0."""
    return F.get(col(x), F.lit(k))


def tail(x: Column, begin: int = 1) -> Column:
    """The elements from begin on."""
    return F.slice(x, F.lit(begin + 1), F.greatest(F.size(x) - begin, F.lit(0)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def pointwise(fn: Callable[[Column], Column]) -> Callable[[Column | str], Column]:
    """A function of numbers as one of the elements of a vector."""
    return lambda x: F.transform(col(x), fn)


def _matrix(array: pa.Array, rows: np.ndarray, size: int | None) -> np.ndarray:
    part = array.take(pa.array(rows))
    if size is None:
        return part.to_numpy(zero_copy_only=False).astype(np.float64)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)


def batched(fn: Callable[..., np.ndarray], *columns: Column | str, returns: str = "array<double>") -> Column:
    """fn of the rows' vectors as matrices (rows, length), numbers as (rows,). It returns a matrix, or numbers for returns='double'."""
    vector = returns.startswith("array")

    def run(*arrays: pa.Array) -> pa.Array:
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        count = len(arrays[0])
        valid = np.ones(count, bool)
        sizes = np.zeros((count, len(arrays)), np.int64)
        for k, a in enumerate(arrays):
            valid &= np.asarray(a.is_valid())
            if pa.types.is_list(a.type):
                sizes[:, k] = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = np.full(count, np.nan) if not vector else [None] * count
        shapes, shape = np.unique(sizes[valid], axis=0, return_inverse=True)
        rows = np.flatnonzero(valid)
        for k, own in enumerate(shapes):
            at = rows[shape.reshape(-1) == k]
            got = np.asarray(fn(*[_matrix(a, at, int(n) if pa.types.is_list(a.type) else None) for a, n in zip(arrays, own, strict=True)]))
            if not vector:
                out[at] = got
            elif len(shapes) == 1 and valid.all():
                offsets = np.arange(count + 1, dtype=np.int32) * got.shape[1]
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(got, dtype=np.float64).reshape(-1)))
            else:
                for row, values in zip(at, got, strict=True):
                    out[row] = values
        if not vector:
            return pa.array(out, pa.float64(), mask=~valid)
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)(*[col(c) for c in columns])


def linear(matrix: np.ndarray) -> Callable[[Column | str], Column]:
    """The product of a constant matrix (outputs, inputs) with each vector."""
    fixed = np.ascontiguousarray(matrix, dtype=np.float64)

    def apply(x: np.ndarray) -> np.ndarray:
        if x.shape[1] != fixed.shape[1]:
            raise ValueError(f"expected vectors of {fixed.shape[1]} numbers, got {x.shape[1]}")
        return x @ fixed.T

    return lambda x: batched(apply, x)


def require(**conditions: bool) -> None:
    """Raises for the first condition that does not hold; names are the messages."""
    for name, holds in conditions.items():
        if not holds:
            raise ValueError(name.replace("_", " "))
