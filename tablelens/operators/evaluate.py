"""Model evaluation tables (A35-A37, C12): confusion matrix and metric rows from
(label, prediction) columns -- one ``groupBy`` of the pairs, everything else on
the #classes^2 result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.numfmt import sig

def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) over the full class x class grid (zero cells kept; the grid is the result)."""
    pairs = df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
    classes = pairs.select("label").union(pairs.select("prediction")).where("label IS NOT NULL").distinct()
    # the grid holds every pair of classes by definition; its rows stay on the executors
    grid = classes.crossJoin(classes.select(F.col("label").alias("prediction")))
    return grid.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 where undefined)."""
    cm = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = support.join(predicted, "c", "full").join(tp, "c", "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select("c", "support", "tp", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    return per.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_score"),
    ).select(F.col("n").cast("long").alias("n"), F.col("correct").cast("long").alias("correct"),
             *[F.round(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1_score"]])


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R^2, MSE, MAE, RMSE over rows where both values are present."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    d = df.where(y.isNotNull() & p.isNotNull())
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
              F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("vy"))
    return s.select(
        "n", sig(F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2_score"),
        sig("mse").alias("mse"), sig("mae").alias("mae"), sig(F.sqrt("mse")).alias("rmse"))
