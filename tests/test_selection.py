"""Bracketed selection against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions.quantiles import quantiles_long
from tablelens.functions.selection import select_ranks


def series():
    g = np.random.default_rng(5)
    return {"normal": g.standard_normal(30_000), "a third equal": np.where(g.random(24_000) < 0.34, 7.0, np.round(g.exponential(5, 24_000), 2)),
            "two values": (g.random(15_000) < 0.5).astype(float), "one value": np.full(12_000, 3.0), "short": g.standard_normal(7),
            "single": np.array([2.5]), "large": np.concatenate([g.standard_normal(11_000), [1e300, -1e300]])}


@pytest.mark.parametrize("most_inside,small", [(200_000, 10_000), (50, 5)])
def test_quantiles_equal_those_of_sorted_values(spark, most_inside, small):
    data = series()
    rows = [(n, float(v)) for n, a in data.items() for v in a]
    long = spark.createDataFrame(rows, "column string, value double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.97, 1.0]
    got = select_ranks(long, probs, lambda n, p: (F.floor((n - 1) * F.lit(p)), F.ceil((n - 1) * F.lit(p))), most_inside, small).collect()
    assert len(got) == len(data) * len(probs)
    for r in got:
        a = np.sort(data[r.column])
        h = (len(a) - 1) * probs[r.pi]
        assert (r.N, r.v_lo, r.v_hi) == (len(a), a[math.floor(h)], a[math.ceil(h)])
        assert (r.before, r.ties) == ((a < r.v_hi).sum(), (a == r.v_hi).sum())
    for r in quantiles_long(long, probs).collect():
        a = np.sort(data[r.column])
        h = (len(a) - 1) * r.prob
        assert r.value == pytest.approx(a[math.floor(h)] + (h - math.floor(h)) * (a[math.ceil(h)] - a[math.floor(h)]), rel=1e-12)
    assert quantiles_long(long.limit(0), probs).count() == 0


def test_the_table_is_not_sorted(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id % 3 AS g", "cast(id % 997 AS double) AS x").write.parquet(path)
    from tablelens.operators.splits import split_stratified
    from tablelens.operators.stats import quartiles
    df = spark.read.parquet(path)
    for out in (quartiles(df, ["x"]), split_stratified(df, ["x"], "g", 0.2)):
        plan = out._jdf.queryExecution().toString()
        assert "rangepartitioning" not in plan


def test_split_with_equal_hashes_takes_exactly_the_share(spark):
    from tablelens.operators.splits import split_random, split_stratified
    rows = [(i % 10, f"r{i}", "ab"[i % 2]) for i in range(400)]  # ten keys only: cuts run through ties
    df = spark.createDataFrame(rows, "k long, name string, y string")
    assert split_random(df, ["k"], 0.33).where("split = 'test'").count() == math.ceil(400 * 0.33)
    got = {r.y: r["count"] for r in split_stratified(df, ["k"], "y", 0.33).where("split = 'test'").groupBy("y").count().collect()}
    assert got == {"a": 66, "b": 66}
    assert split_random(df, ["k"], 0.33).count() == 400 and split_random(df.limit(0), ["k"]).count() == 0


def test_ties_are_not_narrowed_and_columns_equal_series(spark, monkeypatch):
    from tablelens.functions import selection
    from tablelens.functions.quantiles import quantiles
    monkeypatch.setattr(selection, "_narrowed", lambda *a: pytest.fail("few distinct values are gathered at once"))
    rows = [(float(i % 3), None if i % 5 == 0 else float(i % 2), math.nan if i % 7 == 0 else float(i)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    long = df.select("a", "b", F.nanvl("c", F.lit(None).cast("double")).alias("c")).unpivot([], ["a", "b", "c"], "column", "value").where("value IS NOT NULL")
    probs = [0.1, 1 / 3, 0.5, 0.9]
    rank = lambda n, p: (F.floor((n - 1) * F.lit(p)), F.ceil((n - 1) * F.lit(p)))
    got = {}
    few = long.where("column != 'c'")
    for r in select_ranks(few, probs, rank, 500, 5).collect():
        a = np.sort([v for x in rows if (v := x["ab".index(r.column)]) is not None])
        h = (len(a) - 1) * probs[r.pi]
        got[r.column, r.pi] = r.N
        assert (r.N, r.v_lo, r.v_hi) == (len(a), a[math.floor(h)], a[math.ceil(h)])
    assert len(got) == 8
    by_columns = {(r.column, r.prob): r.value for r in quantiles(df, ["a", "b", "c"], probs).collect()}
    assert by_columns == {(r.column, r.prob): r.value for r in quantiles_long(long, probs).collect()} and len(by_columns) == 12
