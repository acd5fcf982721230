"""Relationships: pairwise-complete Pearson matrix (A17-A20, C4) and one-way ANOVA.

The matrix comes from one scan, whatever the number of columns: every task multiplies its Arrow batches into blocks
of sums (products, and counts, sums and squares over the rows where both columns are present), blocks meet in a tree,
and each finished block gives its correlations. ANOVA is one ``groupBy(target)`` with per-group count/mean/variance
for every numeric column at once. Nothing larger than a block of columns squared or #classes x #columns rows leaves a
task at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, is_floating, numeric_columns
from tablelens.functions.distributions import f_pvalue
from tablelens.functions.numfmt import sig
from tablelens.functions.wide import _name
from tablelens.session import scratch_path


BLOCK = 128          # columns of a block
COLUMNS_PER_AGG = 250
FAN = 16             # blocks that meet in one task
_CONSTANT = 1e-12    # share of the squares below which a column is constant on the rows of a pair


def correlation_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col1, col2, i, j, r) for every ordered pair incl. the diagonal.

    Pairwise-complete: each pair uses the rows where both values are present. A cheap pass gives every column's centre,
    which keeps the sum formula accurate; one more multiplies the centred values. A column that is constant on the rows
    used gives NULL, never a divide-by-zero error.
    """
    cols = cols or numeric_columns(df)
    schema = "col1 string, col2 string, i int, j int, r double"
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], schema)
    v = [_val_sql(df, c) for c in cols]
    centre, const, rows = [], [], 0
    for k in range(0, len(cols), COLUMNS_PER_AGG):
        part = range(k, min(k + COLUMNS_PER_AGG, len(cols)))
        first = df.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"{e}").alias(f"{a}{i}") for i in part for a, e in (
            ("m", f"avg({v[i]})"), ("k", f"count({v[i]})"), ("z", f"min({v[i]}) = max({v[i]})"))]).first()
        rows = first["n"]
        centre += [first[f"m{i}"] if first[f"m{i}"] is not None else 0.0 for i in part]
        const += [bool(first[f"z{i}"]) or first[f"k{i}"] < 2 for i in part]
    if not rows:
        return spark.createDataFrame([(a, b, i, j, None) for i, a in enumerate(cols) for j, b in enumerate(cols)], schema)
    mean, constant, blocks = np.array(centre), np.array(const), -(-len(cols) // BLOCK)
    span = [slice(k * BLOCK, min((k + 1) * BLOCK, len(cols))) for k in range(blocks)]

    def multiply(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 8192).columns]).astype(float) - mean
                there = ~np.isnan(x)
                u, m = np.where(there, x, 0.0), there.astype(float)
                own = np.stack([m.T @ m, u.T @ m, m.T @ u, (u * u).T @ m, m.T @ (u * u), u.T @ u])
                total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId()
            for a in range(blocks):
                for b in range(a, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([a], pa.int32()), pa.array([b], pa.int32()),
                                                      pa.array([np.ascontiguousarray(total[:, span[a], span[b]]).tobytes()], pa.binary())], names=["part", "a", "b", "sums"])

    def block(t: pa.Table):
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        shape = (6, span[a].stop - span[a].start, span[b].stop - span[b].start)
        return a, b, sum(np.frombuffer(s, float).reshape(shape) for s in t.sort_by("part").column("sums").to_pylist())

    def meet(t: pa.Table) -> pa.Table:
        a, b, s = block(t)
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()),
                         "sums": pa.array([s.tobytes()], pa.binary())})

    def finish(t: pa.Table) -> pa.Table:
        a, b, (n, si, sj, qi, qj, p) = block(t)
        vi, vj = n * qi - si * si, n * qj - sj * sj
        ok = (n >= 2) & (vi > _CONSTANT * n * qi) & (vj > _CONSTANT * n * qj) & ~constant[span[a]][:, None] & ~constant[span[b]][None, :]
        r = np.divide(n * p - si * sj, np.sqrt(np.where(ok, vi * vj, 1.0)))
        i, j = (g.ravel() for g in np.meshgrid(np.arange(span[a].start, span[a].stop), np.arange(span[b].start, span[b].stop), indexing="ij"))
        r = [None if constant[x] else 1.0 if x == y else float(v) if o else None for x, y, v, o in zip(i.tolist(), j.tolist(), r.ravel().tolist(), ok.ravel().tolist())]
        if a != b:
            i, j, r = np.concatenate([i, j]), np.concatenate([j, i]), r + r
        return pa.table({"col1": pa.array([cols[x] for x in i], pa.string()), "col2": pa.array([cols[y] for y in j], pa.string()),
                         "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "r": pa.array(r, pa.float64())})

    kinds, n_blocks = "part long, a int, b int, sums binary", blocks * (blocks + 1) // 2
    held = _written(df.select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(v)]).mapInArrow(multiply, kinds))
    while held.count() > n_blocks:
        held = _written(held.groupBy("a", "b", F.expr(f"part div {FAN}")).applyInArrow(meet, kinds))
    return held.groupBy("a", "b").applyInArrow(finish, schema)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "gram")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _val_sql(df: DataFrame, c: str) -> str:
    """SQL text of a column as double with NaN read as NULL."""
    x = f"CAST({_name(c)} AS DOUBLE)"
    return f"nanvl({x}, CAST(NULL AS DOUBLE))" if is_floating(df, c) else x


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """A17 as the reference reports it: rounded to ``digits``."""
    return correlation_long(df, cols).select("col1", "col2", F.round("r", digits).alias("correlation"))


def corr_heatmap(df: DataFrame, cols: list[str] | None = None, mask_upper: bool = False) -> DataFrame:
    """C4: heatmap cells; with ``mask_upper`` the cells above the diagonal are NULL."""
    c = correlation_long(df, cols)
    val = F.round("r", 3)
    if mask_upper:
        val = F.when(F.col("j") > F.col("i"), F.lit(None).cast("double")).otherwise(val)
    return c.select("col1", "col2", "i", "j", val.alias("value"))


def high_corr_pairs(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Pairs i < j with |r| > threshold."""
    c = correlation_long(df, cols)
    return c.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold)).select(
        F.col("col1").alias("feature1"), F.col("col2").alias("feature2"), F.round("r", 3).alias("correlation"))


def correlation_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Max |r| (diagonal included), min r, mean |r| (of column means), max off-diagonal |r|."""
    c = correlation_long(df, cols)
    per_col = c.groupBy("j").agg(
        F.avg(F.abs("r")).alias("m"), F.max(F.abs("r")).alias("mx"), F.min("r").alias("mn"),
        F.max(F.when(F.col("i") != F.col("j"), F.abs("r"))).alias("mo"))
    return per_col.agg(
        F.round(F.max("mx"), 6).alias("max_correlation"), F.round(F.min("mn"), 6).alias("min_correlation"),
        F.round(F.avg("m"), 6).alias("mean_abs_correlation"), F.round(F.max("mo"), 6).alias("max_offdiag"))


def target_correlation(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """Correlation of each numeric feature with a numeric target and its strength band."""
    cols = cols or numeric_columns(df)
    feats = [c for c in cols if c != target]
    t = clean_value(df, target).cast("double")
    exprs = []
    for i, c in enumerate(feats):
        x = clean_value(df, c).cast("double")
        both = x.isNotNull() & t.isNotNull()
        xa, ta = F.when(both, x), F.when(both, t)
        exprs.append(F.try_divide(F.covar_samp(xa, ta), F.stddev_samp(xa) * F.stddev_samp(ta)).alias(f"_r{i}"))
    row = df.agg(*exprs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_r{i}").alias("r")) for i, c in enumerate(feats)])).alias("s")).select("s.*")
    return long.where(F.col("r").isNotNull() & ~F.isnan("r")).select(
        "column", F.round("r", 6).alias("correlation_with_target"),
        F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.3, "moderate").otherwise("weak").alias("relationship_strength"))


def group_moments(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(column, class, n, mean, m2) per class of ``target`` for every numeric column, one shuffle.

    Classes are the non-null target values; the table after the aggregate has
    #classes rows, before unpivoting to #classes x #columns.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = clean_value(df, c).cast("double")
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}")]
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(*aggs)
    return g.select("class", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"),
                 F.col(f"_v{i}").alias("var")) for i, c in enumerate(cols)])).alias("s")).select("class", "s.*")


def anova_table(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(column, k, n, f_statistic) raw values of the one-way ANOVA of each feature by target class."""
    cols = cols or [c for c in numeric_columns(df) if c != target]
    gm = group_moments(df, target, cols).where(F.col("n") > 0)
    grand = gm.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))  # a row per column
    gm = gm.join(F.broadcast(grand), "column")
    t = gm.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"))
    return t.where(F.col("k") > 1).select(
        "column", "k", "n",
        F.try_divide(F.col("ssb") / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).alias("f"))


def anova_f(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """F statistic, p-value (F distribution upper tail) and significance per numeric feature."""
    t = anova_table(df, target, cols)
    p = f_pvalue(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return t.withColumn("p", p).select(
        "column", sig(F.coalesce("f", F.lit(0.0))).alias("anova_f_statistic"),
        F.round(F.coalesce("p", F.lit(1.0)), 6).alias("anova_p_value"),
        F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))
