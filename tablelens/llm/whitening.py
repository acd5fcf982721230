"""Whitening of embeddings on a fixed-point grid, by a bidiagonal qd solver.

Every component c of a vector becomes the integer floor(scale * c). The fit uses each distinct integer vector
once, so copies have no weight and sums are exact. Then:

1. exact counts and per-dimension sums, one row per task and dimension;
2. blockwise QR: every task reduces its centred rows to one upper triangle R by stacking block after block; the
   triangles meet in a tree (``fan`` at a time) until one is left, so no task holds more than a block and ``fan``
   triangles. The covariance is R'R / n, and is never formed, so its small eigenvalues keep their digits;
3. the one triangle (dimension x dimension, whatever the number of rows) is bidiagonalised by Householder
   reflections; dqds gives its singular values, twisted factorisations the directions (``bidiagonal``);
4. one pass over the rows projects them, one over the fit list measures the whitened covariance.

Defined results: vectors null, empty, or holding null or non-finite components, or components of 2^52 / scale and
more (beyond exact integers in doubles), take no part and have no rows; vectors of different lengths are fitted
apart; rows with equal or null ids are rows of their own; components without variance (to double precision), so
all of a constant or single vector, are left out; a zero vector is a vector like others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.bidiagonal import right_vectors
from tablelens.llm.common import written
from tablelens.llm.vectors import matrix, packed, unpacked

_BLOCK = 4096


def _grid(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x, dim) of the vectors that take part; x: integers."""
    v = F.col("vec")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 52) / scale))
    fine = (vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
            .where(v.isNotNull() & (F.size(v) > 0) & ~bad))
    return fine.select("id", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"), F.size(v).alias("dim"))


def _blocks(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(k, _BLOCK)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def run(batches):
        n, s = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n += batch.num_rows
            s += matrix(batch.column("x")).astype(np.int64).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([n, *s.tolist()], pa.int64())], names=["at", "s"])

    got = {r["at"]: int(r["s"]) for r in fit.mapInArrow(run, "at int, s long").groupBy("at")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # one row per dimension
    return got[-1], [got[i] for i in range(dim)]


def _triangle(fit: DataFrame, dim: int, mean: np.ndarray, fan: int) -> np.ndarray:
    """R of the centred rows."""
    def stacked(r, block):
        return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")

    def square(r):
        return np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r

    def reduce_task(batches):
        r = None
        for batch in _blocks(batches):
            if batch.num_rows:
                r = stacked(r, matrix(batch.column("x")).astype(float) - mean)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), packed(square(r).reshape(1, -1))], names=["part", "r"])

    def meet(t: pa.Table) -> pa.Table:
        r = None
        for one in unpacked(t.sort_by("part").column("r"), dim * dim):
            r = stacked(r, one.reshape(dim, dim))
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // fan], pa.int64()),
                         "r": packed(square(r).reshape(1, -1))})

    rs = written(fit.mapInArrow(reduce_task, "part long, r binary"), "triangles")
    while rs.count() > 1:
        rs = written(rs.groupBy(F.expr(f"part div {fan}")).applyInArrow(meet, "part long, r binary"), "triangles")
    r = unpacked(pa.array([rs.first()["r"]]), dim * dim).reshape(dim, dim)
    return r


def _identity_error(fit: DataFrame, mean: np.ndarray, turn: np.ndarray, n: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    k = turn.shape[1]

    def run(batches):
        total, seen = np.zeros((k + 1, k)), False
        for batch in _blocks(batches):
            w = (matrix(batch.column("x")).astype(float) - mean) @ turn
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    got = fit.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # components squared
    total = np.zeros((k + 1) * k)
    for r in got:
        total[r["at"]] = r["s"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2 per row, as decimals; wide integers only where 64 bits might not do; null beyond
    38 digits."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    wide = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([Decimal(w) if w < 10 ** 38 else None for w in wide], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256,
           fan: int = 16) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    rows = written(_grid(vectors, id_col, vec_col, scale), "grid")
    fit = written(rows.select("dim", "x").distinct(), "fit")
    out = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
                        T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
                        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                        T.StructField("identity_error", T.DoubleType())])
    found = None
    for dim in sorted(r["dim"] for r in fit.select("dim").distinct().collect()):  # few lengths
        part = _projected(rows.where(F.col("dim") == dim).select("id", "x"), fit.where(F.col("dim") == dim).select("x"),
                          dim, components, fan, out)
        found = part if found is None else found.union(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], out)


def _projected(rows: DataFrame, fit: DataFrame, dim: int, components: int, fan: int, out: T.StructType) -> DataFrame:
    n, sums = _sums(fit, dim)
    mean = np.array([s / n for s in sums])
    r = _triangle(fit, dim, mean, fan)
    values, directions = right_vectors(r, components)
    k = directions.shape[1]
    e = values[:k] ** 2 / n
    explained = (values[:k] ** 2 / (r * r).sum()) if k else e
    turn = directions / np.sqrt(e)
    error = _identity_error(fit, mean, turn, n) if k else 0.0

    def run(batches):
        for batch in _blocks(batches):
            x = matrix(batch.column("x")).astype(np.int64)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 deviations(x, n, sums).take(each), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))], names=out.names)

    return rows.mapInArrow(run, out)
