"""Values at given ranks without sorting: bracketed selection.

1. One pass sorts chunks of each series' values and makes a mergeable sketch (``percentile_approx``) of every eighth
   value of each. It gives each wanted rank a bracket of values that should hold it; short series take their whole range.
2. One pass counts the values below each bracket and inside it, and gathers the distinct values inside, with their
   counts. A bracket that still holds too many rows is narrowed by a sketch of its inside and counted again; each round
   leaves about a 500th. The counts also prove that a bracket holds its ranks; one that does not starts over from the
   whole range.
3. Only the values inside the brackets, a bounded number, are put in order, and the ranks are read off.

Both passes work on Arrow batches; where series are many, the second one is an aggregate over a join with the brackets.

The table is never sorted, shuffled or written; what moves are sketches, counts and the brackets' values. A value that
a third of the rows have is one gathered row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import scratch_path

ACCURACY = 10_000       # a sketch's ranks are off by at most N / ACCURACY
SMALL = 10_000          # series of so many values take their whole range as bracket
MOST_INSIDE = 200_000   # values that a bracket may hold
_GRID = 1_000           # points of a narrowing sketch
_FEW = 10_000           # series whose brackets are sent to every task
_CHUNK = 1 << 16        # values that are sorted at a time for the sketch
_STEP = 8               # of each chunk, every so many-th value goes into the sketch
_MEDIUM = 1_000_000     # series of so many values have wider brackets
_HELD = 1 << 22         # values that a task holds


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _series(batches, wide: bool) -> Iterator[tuple[str, np.ndarray]]:
    """(name, values without nulls) of the series in each batch."""
    for batch in batches:
        if wide:
            for name, column in zip(batch.schema.names, batch.columns):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                if len(values):
                    yield name, values
        elif batch.num_rows:
            codes = batch.column("column").dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            if len(names) > 1:
                values = values[np.argsort(codes, kind="stable")]
            ends = np.cumsum(np.bincount(codes, minlength=len(names)))
            yield from zip(names, np.split(values, ends[:-1]))


def _sketched(data: DataFrame, points: list[float], wide: bool) -> DataFrame:
    """(column, N, least, most, b) of each series, ``b``: values near the ``points``, null where there are too few."""
    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def sketch(name):
            v = np.sort(np.concatenate(held.pop(name)))
            kept, one = v[_STEP // 2::_STEP], sizes.pop(name)
            empty = [None] * len(kept)
            return pa.RecordBatch.from_arrays([pa.array([name] * (len(kept) + 1), pa.string()), pa.array([one, *empty], pa.int64()), pa.array([v[0], *empty], pa.float64()),
                                               pa.array([v[-1], *empty], pa.float64()), pa.array(np.concatenate([[0.0], kept]), mask=np.arange(len(kept) + 1) == 0)],
                                              names=["column", "n", "least", "most", "value"])

        total = 0
        for name, values in _series(batches, wide):
            held.setdefault(name, []).append(values.copy())
            sizes[name] = sizes.get(name, 0) + len(values)
            total += len(values)
            if sizes[name] >= _CHUNK:
                total -= sizes[name]
                yield sketch(name)
            elif total > _HELD:
                total = 0
                for each in list(held):
                    yield sketch(each)
        for each in list(held):
            yield sketch(each)

    rows = data.mapInArrow(run, "column string, n long, least double, most double, value double")
    return rows.groupBy("column").agg(F.sum("n").alias("N"), F.min("least").alias("least"), F.max("most").alias("most"),
                                      F.percentile_approx("value", points, ACCURACY).alias("b"))


def _bracketed(data: DataFrame, open_: DataFrame, wide: bool) -> DataFrame:
    """(column, pi, below, inside) and (column, pi, value, m) rows, to be summed: how many values are below and inside
    each bracket, and the values inside. The brackets are few."""
    brackets: dict[str, list] = {}
    for r in open_.select("column", "pi", "lo", "hi").collect():
        brackets.setdefault(r["column"], []).append((r["pi"], r["lo"], r["hi"]))
    ends = {c: tuple(np.array(x) for x in zip(*sorted(rows))) for c, rows in brackets.items()}

    def rows(columns):
        kinds = [("column", pa.string()), ("pi", pa.int32()), ("below", pa.int64()), ("inside", pa.int64()), ("value", pa.float64()), ("m", pa.int64())]
        n = len(columns["column"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds], names=[c for c, _ in kinds])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for name, values in _series(batches, wide):
            if name not in ends:
                continue
            pi, lo, hi = ends[name]
            v = np.sort(values)
            first, last = np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")
            counts[name] = counts.get(name, 0) + np.stack([first, last - first])
            for i, a, b in zip(pi, first, last):
                if b > a:
                    x, m = np.unique(v[a:b], return_counts=True)
                    yield rows({"column": [name] * len(x), "pi": np.full(len(x), i, np.int32), "value": x, "m": m})
        for name, (below, inside) in counts.items():
            yield rows({"column": [name] * len(below), "pi": ends[name][0].astype(np.int32), "below": below, "inside": inside})

    return _written(data.mapInArrow(run, "column string, pi int, below long, inside long, value double, m long"), "inside")


def select_ranks(long: DataFrame, probs: list[float], ranks: Callable[[Column, float], tuple[Column, Column]],
                 most_inside: int = MOST_INSIDE, small: int = SMALL, wide: DataFrame | None = None) -> DataFrame:
    """(column, pi, N, r_lo, r_hi, v_lo, v_hi, before, ties) for each series of ``long`` (column, value double, no
    nulls) and each probability (``pi``: its place). ``ranks`` gives the two wanted 0-based ranks, within one of
    N x probability, from the series' length and the probability. ``before`` and ``ties``: how many values are less
    than v_hi, and how many equal it. ``wide``: the same series as columns (double or null), where there are few."""
    k, near, far = len(probs), 3.0 / ACCURACY, 0.01
    points = [min(1.0, max(0.0, p + s)) for p in probs for s in (-near, near, -far, far)]
    data = long.select("column", "value").where("column IS NOT NULL") if wide is None else wide
    sketch = _sketched(data, points, wide is not None)
    short, medium = (F.col("N") <= small) | F.col("b").isNull(), F.col("N") <= _MEDIUM  # a step is more of few values

    def bracket(i: int) -> Column:
        lo, hi = ranks(F.col("N"), probs[i])
        return F.struct(F.lit(i).alias("pi"), lo.cast("long").alias("r_lo"), hi.cast("long").alias("r_hi"),
                        F.when(short, F.col("least")).when(medium, F.col("b")[4 * i + 2]).otherwise(F.col("b")[4 * i]).alias("lo"),
                        F.when(short, F.col("most")).when(medium, F.col("b")[4 * i + 3]).otherwise(F.col("b")[4 * i + 1]).alias("hi"))

    open_ = _written(sketch.select("column", "N", "least", "most", F.inline(F.array(*[bracket(i) for i in range(k)]))), "brackets")
    few = open_.count() <= _FEW * k
    while True:
        own = open_.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("pi", "lo", "hi"))).alias("bs"))  # k per series
        met = long.join(F.broadcast(own) if few else own, "column")
        if few:
            parts = _bracketed(data, open_, wide is not None)
            values = parts.where("m IS NOT NULL").groupBy("column", "pi", "value").agg(F.sum("m").alias("m"))
            counted = parts.where("m IS NULL").groupBy("column", "pi").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside"))
            counted = counted.join(values.groupBy("column", "pi").agg(F.count(F.lit(1)).alias("put")), ["column", "pi"], "left")
        else:
            b, v = [F.col("bs")[i] for i in range(k)], F.col("value")
            counted = met.groupBy("column").agg(*[F.sum((v < b[i]["lo"]).cast("long")).alias(f"below{i}") for i in range(k)],
                                                *[F.sum(((v >= b[i]["lo"]) & (v <= b[i]["hi"])).cast("long")).alias(f"inside{i}") for i in range(k)])
            counted = counted.select("column", F.inline(F.array(*[
                F.struct(F.lit(i).alias("pi"), F.col(f"below{i}").alias("below"), F.col(f"inside{i}").alias("inside")) for i in range(k)]))).withColumn("put", F.col("inside"))
        state = _written(open_.join(counted, ["column", "pi"]), "brackets")
        holds = (F.col("below") <= F.col("r_lo")) & (F.col("r_hi") < F.col("below") + F.col("inside"))
        much = (F.coalesce("put", F.lit(0)) > most_inside) & (F.col("lo") < F.col("hi"))
        if state.where(~holds | much).isEmpty():
            break
        narrower = _narrowed(met, state, k, holds, much)
        if narrower.join(state.select("column", "pi", F.col("lo").alias("lo0"), F.col("hi").alias("hi0")), ["column", "pi"]).where(
                (F.col("lo") != F.col("lo0")) | (F.col("hi") != F.col("hi0"))).isEmpty():
            break  # what is left are ties: few distinct values, however many rows
        open_ = narrower
    if not few:
        inside = met.select("column", "value", F.explode(F.filter("bs", lambda x: (F.col("value") >= x["lo"]) & (F.col("value") <= x["hi"]))).alias("in"))
        values = inside.groupBy("column", F.col("in.pi").alias("pi"), "value").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("column", "pi").orderBy("value")
    before = F.col("below") + F.sum("m").over(order) - F.col("m")
    ranked = values.join(state, ["column", "pi"]).withColumn("before", before)
    holds_rank = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("m"))
    return ranked.groupBy("column", "pi", "N", "r_lo", "r_hi").agg(
        F.max(F.when(holds_rank("r_lo"), F.col("value"))).alias("v_lo"), F.max(F.when(holds_rank("r_hi"), F.col("value"))).alias("v_hi"),
        F.max(F.when(holds_rank("r_hi"), F.col("before"))).alias("before"), F.max(F.when(holds_rank("r_hi"), F.col("m"))).alias("ties"))


def _narrowed(met: DataFrame, state: DataFrame, k: int, holds: Column, wide: Column) -> DataFrame:
    """The brackets, those that hold too much cut down by a sketch of their inside."""
    grid = [j / _GRID for j in range(_GRID + 1)]
    inside = met.select("column", "value", F.explode(F.filter("bs", lambda x: (F.col("value") >= x["lo"]) & (F.col("value") <= x["hi"]) & (x["lo"] < x["hi"]))).alias("in"))
    sketch = inside.groupBy("column", F.col("in.pi").alias("pi")).agg(F.percentile_approx("value", grid, ACCURACY).alias("g"))
    at = lambda r, step: F.element_at("g", (F.least(F.lit(_GRID), F.greatest(
        F.lit(0), F.floor((F.col(r) - F.col("below")) / F.col("inside") * _GRID) + step)) + 1).cast("int"))
    both = state.join(sketch, ["column", "pi"], "left")
    lo = F.when(~holds, F.col("least")).when(wide & F.col("g").isNotNull(), F.greatest(F.col("lo"), at("r_lo", -1))).otherwise(F.col("lo"))
    hi = F.when(~holds, F.col("most")).when(wide & F.col("g").isNotNull(), F.least(F.col("hi"), at("r_hi", 2))).otherwise(F.col("hi"))
    return _written(both.select("column", "N", "least", "most", "pi", "r_lo", "r_hi", lo.alias("lo"), hi.alias("hi")), "brackets")
