"""Feature selection and reduction.

Univariate scores come from the shared aggregates (ANOVA F by class, or
F-regression from the correlation with a numeric target); mutual information
is binned (decile buckets x target classes, one ``groupBy``); PCA uses Spark
ML on centred vectors (its ``transform`` does not centre).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, numeric_columns
from tablelens.functions.quantiles import quantiles_wide
from tablelens.operators.relate import anova_table


def univariate_scores(df: DataFrame, target: str, cols: list[str] | None = None,
                      task: str = "classification") -> DataFrame:
    """(feature, ordinal, score): ANOVA F for a class target, F-regression for a numeric one."""
    cols = cols or [c for c in numeric_columns(df) if c != target]
    order = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, ordinal int")
    if task == "classification":
        s = anova_table(df, target, cols).select(F.col("column").alias("feature"), F.col("f").alias("score"))
    else:
        t = clean_value(df, target).cast("double")
        exprs = []
        for i, c in enumerate(cols):
            x = clean_value(df, c).cast("double")
            both = x.isNotNull() & t.isNotNull()
            xa, ta = F.when(both, x), F.when(both, t)
            exprs += [F.try_divide(F.covar_samp(xa, ta), F.stddev_samp(xa) * F.stddev_samp(ta)).alias(f"r{i}"),
                      F.count(xa).alias(f"n{i}")]
        row = df.agg(*exprs)
        long = row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(cols)])).alias("s")).select("s.*")
        s = long.select("feature", F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r"))
                        .__mul__(F.col("n") - 2).alias("score"))
    return order.join(s, "feature", "left")


def select_k_best(df: DataFrame, target: str, k: int = 10, cols: list[str] | None = None,
                  task: str = "classification") -> DataFrame:
    """M9: (feature, score, rank, selected) -- the k highest scores (ties in column order)."""
    s = univariate_scores(df, target, cols, task)
    w = Window.orderBy(F.desc_nulls_last("score"), "ordinal")  # one row per feature: small
    return s.withColumn("rank", F.row_number().over(w)).select(
        "feature", "score", "rank", (F.col("rank") <= k).alias("selected"))


def mutual_information(df: DataFrame, target: str, cols: list[str] | None = None, bins: int = 10) -> DataFrame:
    """M10 (re-aimed): mutual information of quantile-binned features with a class target, in nats."""
    cols = cols or [c for c in numeric_columns(df) if c != target]
    probs = [i / bins for i in range(1, bins)]
    names = [f"b{i}" for i in range(1, bins)]
    q = {r["column"]: [r[n] for n in names] for r in quantiles_wide(df, cols, probs, names).collect()}
    y = F.col(target).cast("string")
    edges = [np.array(sorted(e for e in q.get(c, []) if e is not None)) for c in cols]

    def counted(batches):
        """(feature, bin, class, rows) of each batch; a value's bin is the number of edges below it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            classes, codes = codes.dictionary, codes.indices.to_numpy()
            for f, c in enumerate(cols):
                x = batch.column(f + 1)
                on = x.is_valid().to_numpy(zero_copy_only=False)
                key = np.searchsorted(edges[f], x.to_numpy(zero_copy_only=False)[on], "left") * len(classes) + codes[on]
                n = np.bincount(key)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.string()), pa.array(at // len(classes), pa.int32()),
                                                  classes.take(pa.array(at % len(classes))), pa.array(n[at], pa.int64())], names=["feature", "bin", "_y", "n"])

    d = df.where(y.isNotNull()).select(y.alias("_y"), *[clean_value(df, c).cast("double").alias(c) for c in cols])
    joint = d.mapInArrow(counted, "feature string, bin int, _y string, n long").groupBy("feature", "bin", "_y").agg(F.sum("n").alias("n_xy"))
    # sum n_xy/n ln(n_xy n / (n_x n_y)) = (sum n_xy ln n_xy - sum n_x ln n_x - sum n_y ln n_y) / n + ln n: sums of sums,
    # so that no task holds all classes or bins of a feature
    entropy = lambda c: F.sum(F.col(c) * F.log(c))
    xy = joint.groupBy("feature").agg(F.sum("n_xy").alias("n"), entropy("n_xy").alias("s_xy"))
    side = lambda by, out: (joint.groupBy("feature", by).agg(F.sum("n_xy").alias("_m")).groupBy("feature").agg(entropy("_m").alias(out)))
    mi = (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / F.col("n") + F.log("n")
    return xy.join(side("bin", "s_x"), "feature").join(side("_y", "s_y"), "feature").select("feature", F.round(F.greatest(mi, F.lit(0.0)), 6).alias("mutual_information"))


def pca(df: DataFrame, cols: list[str], k: int = 2, fill_null: bool = True):
    """Fit PCA on centred vectors. Returns (model pipeline pieces, centred frame, assembler)."""
    if len(cols) < 2:
        raise ValueError("PCA needs at least two numeric columns")
    src = df.select(*[F.coalesce(clean_value(df, c).cast("double"), F.lit(0.0)).alias(c) if fill_null
                      else clean_value(df, c).cast("double").alias(c) for c in cols], *[c for c in df.columns if c not in cols])
    vec = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="skip").transform(src)
    centre = StandardScaler(inputCol="_features", outputCol="_centred", withMean=True, withStd=False).fit(vec)
    cv = centre.transform(vec)
    model = PCA(k=k, inputCol="_centred", outputCol="_pcs").fit(cv)
    return model, cv


def pca_variance(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """(component, explained_variance_ratio, cumulative_ratio)."""
    k = k or len(cols)
    model, _ = pca(df, cols, k)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i + 1, r, cum))
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative_ratio double")


def pca_project(df: DataFrame, cols: list[str], keep: list[str], k: int = 2) -> DataFrame:
    """The rows projected on the first k centred principal components (pc1..pck)."""
    model, cv = pca(df, cols, k)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(cv).withColumn("_a", vector_to_array("_pcs"))
    return out.select(*keep, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])


def auto_components(ratios: list[float], n_features: int, target: float = 0.95) -> int:
    """First k with cumulative ratio >= target, capped at n_features // 2 (at least 1)."""
    cum = 0.0
    k = len(ratios)
    for i, r in enumerate(ratios):
        cum += r
        if cum >= target:
            k = i + 1
            break
    return max(1, min(k, n_features // 2)) if n_features >= 2 else 1


def importance_ensemble(importances: DataFrame) -> DataFrame:
    """Average each feature's importance over models, normalise to sum 1; (feature, importance, rank).

    ``importances`` has columns (model, feature, importance); a model lacking a feature counts 0 for it.
    """
    return _ensemble(importances)


def _ensemble(importances: DataFrame) -> DataFrame:
    # every window below runs over a features-sized table (one row per feature)
    w_all = Window.partitionBy()
    per = importances.groupBy("feature").agg(F.sum("importance").alias("s"), F.collect_set("model").alias("_ms"))
    per = per.withColumn("_models", F.size(F.array_distinct(F.flatten(F.collect_list("_ms").over(w_all)))))
    per = per.withColumn("a", F.col("s") / F.col("_models"))
    per = per.withColumn("t", F.sum("a").over(w_all))
    norm = F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(F.col("a"))
    out = per.select("feature", norm.alias("importance"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).select(
        "feature", F.round("importance", 6).alias("importance"), "rank")
