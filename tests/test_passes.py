"""How often rows that are costly to derive are evaluated, and what a ranking moves."""

import hashlib

from tablelens.functions.ranking import sorted_row_number
from tablelens.operators.explain import permuted


def counted(spark, df):
    """The frame, and the number of rows that were evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_permuted_rows_are_evaluated_once(spark):
    n = 500
    df, seen = counted(spark, spark.range(n).selectExpr("concat('k', id) AS k", "cast(id AS double) AS a", "id % 7 AS b"))
    got = sorted(permuted(df, ["k"], ["a", "b"], keep=["a"]).collect())
    assert seen.value <= 2 * n  # the bounds of the slices are drawn from a run of their own
    keys = sorted(f"k{i}" for i in range(n))
    dealt = sorted(keys, key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    assert got == sorted((float(k[1:]), float(d[1:]), int(d[1:]) % 7) for k, d in zip(keys, dealt))


def test_row_numbers_shuffle_rows_once(spark):
    df = spark.range(3_000).selectExpr("id", "CASE WHEN id % 4 < 3 THEN id % 4 END AS g", "pmod(hash(id), 50) AS h")
    out = sorted_row_number(df, ["g"], ["h", "id"])
    assert "_loc_" not in out._jdf.queryExecution().toString()  # no window over the rows
    rows, place = out.orderBy("g", "h", "id").collect(), {}
    for r in rows:
        place[r.g] = place.get(r.g, 0) + 1
        assert r.rn == place[r.g]
    assert len(rows) == 3_000 and sorted_row_number(df.limit(0), [], ["h", "id"]).count() == 0


def test_regression_rows_are_derived_once(spark, monkeypatch, tmp_path):
    from tablelens.plans import queries_ml as Q
    n = 400
    rows = spark.range(n).selectExpr("concat('k', id) AS row_key", *[f"cast(pmod(hash(id, {i}), 50) AS double) AS {c}" for i, c in enumerate(Q._REG_FEATS)],
                                     "cast(pmod(hash(id), 997) AS double) AS l_extendedprice")
    df, seen = counted(spark, rows)
    monkeypatch.setattr(Q, "_items", lambda s, d: df)
    assert Q._train_eval(spark, str(tmp_path), "ridge", "regression").count() == 1
    assert seen.value == n
