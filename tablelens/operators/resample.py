"""Over-sampling of minority classes (M20 SMOTE, M21 ADASYN) and kNN-based
models / imputation (M13 knn, P7), all on the exact distributed kNN join.

Synthetic points are ``x + lambda * (neighbour - x)`` with ``lambda`` and the
neighbour choice derived from hashes of (seed, point id, copy number), so the
output is reproducible and every copy is generated where its base point lives
(``explode(sequence)`` -- no driver loop, no per-class task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.knn import knn
from tablelens.functions.ranking import row_number

SEED = 42


def _u01(*cols) -> F.Column:
    """A uniform number in [0, 1) from a hash of the given columns."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _synthetic_id() -> F.Column:
    """Negative, from a hash of the base point's id and the copy's number."""
    return -F.pmod(F.xxhash64(F.lit(SEED + 2), "id", "copy"), F.lit((1 << 62) - 1)) - 1


def _interpolate(base: str, nb: str, lam: str) -> F.Column:
    return F.zip_with(F.col(base), F.col(nb), lambda a, b: a + F.col(lam) * (b - a))


def _minorities(base: DataFrame, label: str) -> DataFrame:
    """The rows of classes to grow, with ``need`` (rows that the class lacks) and ``n_c``; one row at least to pair with."""
    counts = base.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("n_c"))
    majority = counts.agg(F.max("n_c")).first()[0] or 0
    small = counts.where((F.col("n_c") < majority) & (F.col("n_c") >= 2)).withColumn("need", F.lit(majority) - F.col("n_c"))
    return base.join(small, F.col(label) == F.col("_c")).drop("_c")


def _grown(members: DataFrame, quota: DataFrame, label: str, k: int) -> DataFrame:
    """Synthetic rows: each of ``quota`` (id, _g) makes _g points towards neighbours of its class. All classes in one plan."""
    nb = knn(members, k, "id", "vec", group=label).select(F.col("qid").alias("id"), F.col("rank").alias("nrank"), "nid")
    gen = members.join(quota.where(F.col("_g") > 0), "id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_g").cast("int") - 1)))
    kk = F.least(F.lit(k), (F.col("n_c") - 1).cast("int"))
    gen = gen.withColumn("nrank", (F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "copy"), kk) + 1).cast("int")).join(nb, ["id", "nrank"])
    nvec = members.select(F.col("id").alias("nid"), F.col("vec").alias("nvec"))
    gen = gen.join(nvec, "nid").withColumn("lam", _u01(F.col("id"), F.col("copy")))
    return gen.select(_synthetic_id().alias("id"), _interpolate("vec", "nvec", "lam").alias("vec"), label, F.lit(True).alias("synthetic"))


def _base(df: DataFrame, id_col: str, vec_col: str, label: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), label)


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, k: int = 5) -> DataFrame:
    """(id, vec, label, synthetic) -- every minority class grown to the majority count. Rows without a label are
    kept as they are."""
    base = _base(df, id_col, vec_col, label)
    members = _minorities(base, label)
    ranked = row_number(members.select("id", label, "need", "n_c").withColumn("_h", F.xxhash64(F.lit(SEED), "id")), [label], ["_h", "id"], "_r")
    quota = ranked.select("id", (F.expr("need div n_c") + F.when(F.col("_r") <= F.col("need") % F.col("n_c"), 1).otherwise(0)).alias("_g"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(_grown(members, quota, label, k))


def adasyn(df: DataFrame, id_col: str, vec_col: str, label: str, k: int = 5) -> DataFrame:
    """Like SMOTE, but each minority point's share of the new points grows with the
    fraction of other-class points among its k nearest neighbours (He et al., 2008)."""
    base = _base(df, id_col, vec_col, label)
    members = _minorities(base, label)
    near = knn(base, k, "id", "vec")
    own = members.select(F.col("id").alias("qid"), F.col(label).alias("_ql"), "need")
    labels = base.select(F.col("id").alias("nid"), F.col(label).alias("_nl"))
    ratio = (near.join(own, "qid").join(labels, "nid").groupBy("qid", "_ql", "need")
             .agg((F.sum(F.when(F.col("_nl") != F.col("_ql"), 1).otherwise(0)) / k).alias("r")))
    total = ratio.groupBy(F.col("_ql").alias("_tl")).agg(F.sum("r").alias("total")).where("total > 0")  # a row per class
    quota = ratio.join(total, F.col("_ql") == F.col("_tl")).select(
        F.col("qid").alias("id"), F.round(F.col("r") / F.col("total") * F.col("need")).cast("int").alias("_g"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(_grown(members, quota, label, k))


def knn_predict(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, label: str, k: int = 5,
                task: str = "classification") -> DataFrame:
    """M13 knn: (id, prediction) by majority vote (ties -> smallest label) or neighbour mean."""
    nb = knn(train, k, id_col, vec_col, queries=test)
    lab = train.select(F.col(id_col).cast("long").alias("nid"), F.col(label).alias("_y"))
    j = nb.join(lab, "nid")
    if task == "classification":
        votes = j.groupBy("qid", "_y").agg(F.count(F.lit(1)).alias("v"))
        w = Window.partitionBy("qid").orderBy(F.desc("v"), "_y")
        pred = votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
            F.col("qid").alias(id_col), F.col("_y").alias("prediction"))
    else:
        pred = j.groupBy("qid").agg(F.avg(F.col("_y").cast("double")).alias("prediction")).withColumnRenamed("qid", id_col)
    return pred


def impute_knn(df: DataFrame, id_col: str, column: str, feature_cols: list[str], k: int = 5) -> DataFrame:
    """P7 (opt-in): fill ``column`` with the mean of the k nearest complete rows in the feature space.

    Features are the other numeric columns with their own missing values mean-filled.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feature_cols]).first()
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c] if means[c] is not None else 0.0))
                    for c in feature_cols])
    d = df.withColumn("_vec", vec)
    donors = d.where(F.col(column).isNotNull())
    need = d.where(F.col(column).isNull())
    if need.isEmpty():
        return df
    nb = knn(donors, k, id_col, "_vec", queries=need)
    fill = nb.join(donors.select(F.col(id_col).cast("long").alias("nid"), F.col(column).cast("double").alias("_v")), "nid") \
        .groupBy("qid").agg(F.avg("_v").alias("_fill"))
    out = df.join(fill.withColumnRenamed("qid", "_qid"), F.col(id_col).cast("long") == F.col("_qid"), "left")
    return out.select(*[F.coalesce(F.col(column).cast("double"), F.col("_fill")).alias(column) if c == column
                        else F.col(c) for c in df.columns])

