"""Vectors as rows: validity, doubles as bytes, distinct vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_mark(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, fine): whether a row takes part."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0.0)
    return rows.withColumn("fine", F.coalesce(fine, F.lit(False)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the vectors that take part: id not null, vector not null, no component null or not finite,
    not zero."""
    return _with_mark(vectors, id_col, vec_col).where("fine").select("id", "vec", F.size("vec").alias("dim"))


def unusable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id) of the other rows."""
    return _with_mark(vectors, id_col, vec_col).where("NOT fine").select("id")


def matrix(column) -> np.ndarray:
    """A column of equal-length double lists as a matrix."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix of doubles as binary values."""
    width = m.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(width), len(m), [None, pa.py_buffer(np.ascontiguousarray(m, dtype="<f8"))]).cast(pa.binary())


def unpacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)
