"""Fitted preprocessors: the same result before and after saving, on other rows, alone and in a pipeline."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablelens.operators import prep, scaling
from tablelens.operators.stages import Preprocess, Preprocessor


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(400).select(
        F.col("id"), F.lit(3).alias("same"), F.when(F.col("id") % 20 == 0, None).otherwise(F.col("id") * 1.5).alias("few"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).alias("many"),
        F.when(F.col("id") % 5 < 4, None).otherwise(F.lit(1.0)).alias("mostly"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("kind"),
        F.concat(F.lit("v"), F.col("id") % 37).alias("name"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("target"))
    return df


ALL = ["drop_constant", "impute", "onehot", "label", "winsorize", ("standard", ["few"]), ("minmax", ["many"]), ("robust", ["id"])]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_steps_give_what_the_operators_give(spark, table, tmp_path):
    model = Preprocess(ALL[:5], "target").fit(table)
    got = model.transform(table)
    want, _ = prep.preprocess(table, "target")
    assert rows(got) == rows(want)
    scaled = Preprocess([("standard", ["few"]), ("minmax", ["many"]), ("robust", ["id"])]).fit(table).transform(table)
    plain = scaling._apply(table, scaling.fit_standard(table, ["few"]) | scaling.fit_minmax(table, ["many"]) | scaling.fit_robust(table, ["id"]))
    assert rows(scaled) == rows(plain)


def test_saved_preprocessors_apply_what_was_fitted(spark, table, tmp_path):
    model = Preprocess(ALL, "target").fit(table.where("id < 300"))
    model.write().overwrite().save(str(tmp_path / "p"))
    again = Preprocessor.load(str(tmp_path / "p"))
    other = table.where("id >= 300").withColumn("extra", F.lit("x"))
    assert rows(again.transform(other)) == rows(model.transform(other)) and "extra" in again.transform(other).columns
    assert again.transform(other.limit(0)).count() == 0
    unseen = spark.createDataFrame([(1, 3, 1.0, None, None, "new", "new", "maybe")], table.schema)
    r = again.transform(unseen).first()
    assert r["name"] is None and r["target"] is None and not r["kind_c1"] and not r["kind_c2"] and r["many"] is not None
    assert again.transform(table.drop("name", "few")).count() == 400


def test_preprocessors_in_a_pipeline(spark, table, tmp_path):
    fitted = Pipeline(stages=[Preprocess(["impute"]), Preprocess([("standard", ["few", "many"])])]).fit(table)
    fitted.write().overwrite().save(str(tmp_path / "pipe"))
    assert rows(PipelineModel.load(str(tmp_path / "pipe")).transform(table)) == rows(fitted.transform(table))
    with pytest.raises(ValueError):
        Preprocess(["nonsense"])
