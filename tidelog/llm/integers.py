"""Vectors as integers: each component becomes floor(256 * x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

SCALE = 256
#: Squared length, in integers, from which on a vector takes no part: inner products and squared distances of shorter ones fit into 64 bits.
TOO_LONG = 2.0**60


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> DataFrame:
    """(vec_id, dim, vec): the vectors that take part, components as 64-bit integers in bytes. ``length``: the only number of components allowed.

    Null and empty vectors, those with null or non-finite components, and those too long for 64-bit arithmetic (see ``TOO_LONG``) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            dims = col.value_lengths().fill_null(0).to_numpy()
            x = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is not a number
            row = np.repeat(np.arange(len(dims)), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.bincount(row, np.where(np.isfinite(x), x * x, np.inf), len(dims))
            good = (dims > 0) & (size < TOO_LONG) & ((dims == length) if length else True)
            ints = np.where(good[row], x, 0).astype("<i8").tobytes()
            end = np.cumsum(dims) * 8
            raw = [ints[e - 8 * d : e] for e, d in zip(end[good].tolist(), dims[good].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array(dims[good], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "vec"])

    plain = pick(rows, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return plain.mapInArrow(run, "vec_id long, dim int, vec binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(n, dim) integers of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)
