"""Target validation (P15), facades (E1-E4) and the streaming drift monitor."""

import pytest
from pyspark.sql import functions as F

from tablelens.operators import prep
from tablelens.plans import facade
from tablelens.session import scratch_path
from tablelens.streaming.monitor import drift_monitor


def test_validate_target(spark, f1):
    prep.validate_target(f1, "target")
    with pytest.raises(ValueError):
        prep.validate_target(f1, "missing")
    with pytest.raises(ValueError):
        prep.validate_target(f1.withColumn("c", F.lit("x")), "c")
    with pytest.raises(ValueError):
        prep.validate_target(f1.withColumn("c", F.lit(None).cast("string")), "c")


def test_profile_and_eda_sections(spark, f1):
    p = facade.profile_table(f1, ["id"])
    assert p["quality_report"].count() == 5 and p["preview"].count() == 10
    sections, errors = facade.eda(f1, "target")
    assert not errors
    assert {"descriptive_numeric", "correlation", "outliers", "target_relationships"} <= set(sections)
    rep = facade.report(f1, "target")
    assert rep.where("section = 'descriptive_numeric'").count() > 0


def test_a_section_that_fails_while_it_runs_loses_no_other(spark, f1, monkeypatch):
    broken = f1.select("target", F.raise_error(F.lit("boom")).cast("double").alias("x"))
    monkeypatch.setattr(facade.stats, "categorical_stats", lambda df, cat: broken)
    rep = facade.report(f1, "target")
    got = {r["section"] for r in rep.select("section").distinct().collect()}
    assert {"errors", "descriptive_numeric", "shapiro_wilk", "anderson_darling", "chart_plan", "chart_box_age"} <= got
    assert "descriptive_categorical" not in got
    assert "boom" in rep.where("section = 'errors'").first()["value"]


def test_drift_monitor_stream(spark):
    src = scratch_path(spark, "stream-src")
    base = spark.range(200).select(F.col("id").cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    base.write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    training = spark.range(200).select((F.col("id") + 500).cast("double").alias("x"), F.lit("a").alias("c"))
    sink = scratch_path(spark, "stream-sink")
    q = drift_monitor(stream, training, sink, scratch_path(spark, "stream-ckpt"), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    rows = {r["column"]: r for r in out.collect()}
    assert rows["x"]["drifted"] and rows["x"]["score"] == 1.0
    assert rows["c"]["infinite"] and rows["c"]["overall_drift"]
