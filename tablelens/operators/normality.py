"""Normality tests (A30 Shapiro-Wilk, A31 Anderson-Darling) without SciPy.

Shapiro-Wilk runs on a bounded, seeded sample per column (<= 5,000 values, as in
the reference): rows are ordered by a hash of their content, a per-column
threshold keeps a few times the needed candidates, and an exact top-k over
that bounded set picks the sample. One ``applyInPandas`` group per column then
evaluates Royston's AS R94 approximation on at most 5,000 values.

Anderson-Darling uses every value: the statistic only needs each value's rank,
which the distributed running sum over the value-frequency table provides, so
the sum over ranks is one aggregate.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, numeric_columns
from tablelens.functions.distributions import norm_cdf, norm_sf
from tablelens.functions.ranking import running_sum
from tablelens.operators.stats import numeric_summary
from tablelens.operators.tree_growth import key_of, mix
from tablelens.session import scratch_path

SAMPLE_CAP = 5000
SEED = 42

# fixed values: polynomial coefficients of Royston (1995), algorithm AS R94
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def _poly(c, x):
    out = 0.0
    for coef in reversed(c):
        out = out * x + coef
    return out


def shapiro_wilk_np(x: np.ndarray) -> tuple[float, float]:
    """(W, p) for a 1-D sample, Royston's approximation; n < 3 -> (nan, 1.0)."""
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if n < 3:
        return float("nan"), 1.0
    rng = x[-1] - x[0]
    if rng <= 0:
        return float("nan"), 1.0
    nn2 = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        nd = NormalDist()
        m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, nn2 + 1)])
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(_C1, rsn) - m[0] / ssumm2
        if n > 5:
            a2 = -m[1] / ssumm2 + _poly(_C2, rsn)
            fac = math.sqrt((summ2 - 2.0 * m[0] ** 2 - 2.0 * m[1] ** 2) / (1.0 - 2.0 * a1 ** 2 - 2.0 * a2 ** 2))
            a = -m / fac
            a[0], a[1] = a1, a2
        else:
            fac = math.sqrt((summ2 - 2.0 * m[0] ** 2) / (1.0 - 2.0 * a1 ** 2))
            a = -m / fac
            a[0] = a1
    xs = x / rng
    num = float(np.sum(a * (xs[::-1][:nn2] - xs[:nn2])))
    ss = float(np.sum((xs - xs.mean()) ** 2))
    w = min(num * num / ss, 1.0)
    if n == 3:
        p = (6.0 / math.pi) * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, min(1.0, p))
    if n <= 11:
        gamma = _poly(_G, n)
        lw = math.log1p(-w) if w < 1 else -math.inf
        if gamma <= lw:
            return w, 1e-99
        w1 = -math.log(gamma - lw)
        mu = _poly(_C3, n)
        sd = math.exp(_poly(_C4, n))
    else:
        ln = math.log(n)
        w1 = math.log1p(-w) if w < 1 else -math.inf
        mu = _poly(_C5, ln)
        sd = math.exp(_poly(_C6, ln))
    if math.isinf(w1):
        return w, 1.0
    z = (w1 - mu) / sd
    return w, 0.5 * math.erfc(z / math.sqrt(2.0))


def normality_sample(df: DataFrame, cols: list[str], cap: int = SAMPLE_CAP, seed: int = SEED, fan: int = 32) -> DataFrame:
    """(column, value): up to ``cap`` non-missing values per column, a bottom-k sample.

    Every row has a draw of its own (a hash of its partition and place), so equal rows are sampled in proportion. A
    task keeps the ``cap`` least draws per column; these meet in a tree, ``fan`` tasks at a time."""
    kinds = "column string, part long, draw long, value double"

    def least(draws, values):
        if len(draws) > cap:
            at = np.argpartition(draws, cap - 1)[:cap]
            draws, values = draws[at], values[at]
        return draws, values

    def sample(batches):
        part, row = TaskContext.get().partitionId(), 0
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(cols)
        for batch in batches:
            place = np.arange(row, row + batch.num_rows, dtype=np.uint64)
            row += batch.num_rows
            draws = (mix(mix(place) ^ key_of(seed, part)) >> np.uint64(1)).astype(np.int64)
            for k in range(len(cols)):
                v = batch.column(k).to_numpy(zero_copy_only=False).astype(float)
                on = ~np.isnan(v)
                held[k] = least(np.concatenate([held[k][0], draws[on]]), np.concatenate([held[k][1], v[on]]))
        for k, (d, v) in enumerate(held):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([cols[k]] * len(d)), pa.array(np.full(len(d), part)), pa.array(d), pa.array(v)], names=["column", "part", "draw", "value"])

    def meet(t: pa.Table) -> pa.Table:
        d, v = least(t.column("draw").to_numpy(), t.column("value").to_numpy())
        return pa.table({"column": pa.array([t.column("column")[0].as_py()] * len(d), pa.string()),
                         "part": pa.array(np.full(len(d), t.column("part")[0].as_py() // fan)), "draw": pa.array(d), "value": pa.array(v)})

    out = df.select(*[clean_value(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(sample, kinds)
    parts = df.rdd.getNumPartitions()
    while True:
        path = scratch_path(df.sparkSession, "sample")
        out.write.parquet(path)
        out = df.sparkSession.read.parquet(path)
        if parts <= 1:
            return out.select("column", "value")
        out = out.groupBy("column", F.expr(f"part div {fan}")).applyInArrow(meet, kinds)
        parts = -(-parts // fan)


def shapiro_wilk(df: DataFrame, cols: list[str] | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """(column, n_sample, w_statistic, p_value, is_normal)."""
    cols = cols or numeric_columns(df)
    sample = normality_sample(df, cols, cap)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk_np(pdf["value"].to_numpy())
        n = len(pdf)
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n_sample": [n],
                             "w_statistic": [None if math.isnan(w) else round(w, 6)],
                             "p_value": [round(p, 6)], "is_normal": [bool(n >= 3 and p > 0.05)]})

    return sample.groupBy("column").applyInPandas(
        test, "column string, n_sample long, w_statistic double, p_value double, is_normal boolean")


def anderson_darling(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A^2 of each column against a normal with the sample mean and (ddof 1) std."""
    cols = cols or numeric_columns(df)
    s = numeric_summary(df, cols, ["count", "mean", "std"]).select("column", "mean", "std", F.col("count").cast("long").alias("N"))
    wide = df.select(*[clean_value(df, c).cast("double").alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).cast("long").alias("m"))
    cum = running_sum(freq, ["column"], ["value"], ["m"]).withColumn("r", F.col("cum_m") - F.col("m"))
    z = cum.join(F.broadcast(s), "column").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    tiny = F.lit(1e-300)
    z = z.withColumn("lcdf", F.log(F.greatest(norm_cdf(F.col("z")), tiny))) \
         .withColumn("lsf", F.log(F.greatest(norm_sf(F.col("z")), tiny)))
    m, r, n = F.col("m"), F.col("r"), F.col("N")
    # ranks r+1 .. r+m share one value: sum(2i-1) and sum(2(n-i)+1) over that block
    s_lo = (r + m) * (r + m) - r * r
    s_hi = m * (2 * n + 1) - m * (2 * r + m + 1)
    contrib = s_lo.cast("double") * F.col("lcdf") + s_hi.cast("double") * F.col("lsf")
    agg = z.groupBy("column").agg(F.sum(contrib).alias("S"), F.first("N").alias("N"), F.first("std").alias("std"))
    return agg.select("column", F.when((F.col("N") >= 3) & (F.col("std") > 0),
                                       F.round(-F.col("N") - F.col("S") / F.col("N"), 6)).alias("anderson_darling_stat"))
