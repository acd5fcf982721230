"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same wanted number of copies, target / size of the source. Its whole
part is taken; its fraction is a mass of ``fraction x size`` words. Within a source, documents meet in
pairs: mass moves from one to the other, in a random direction whose odds keep each expected value, until
one of the two holds nothing or a whole copy. A group of documents so ends with at most one fractional
document; these residuals go up a reduction tree (each node pairs up to ``fan_in`` residuals) until each
source has one, which one draw decides. The words taken in a source therefore miss its target by less than
one document, and every document keeps its expected share.

Groups are hash buckets of one source, so a source of any share of the rows is spread. Draws depend on the
seed, the source and the documents only: reruns agree.

Defined results: sizes are counts of words between ASCII white space, null texts 0; documents without words
take no mass (they get the whole copies, and the fraction by a draw of their own); the null source comes
last; rows that agree in id, source and size are one unit: its share of extra copies, a whole number but for one
row, is dealt to its rows in the order of their texts' hashes, and only that one row enters the pairs; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.ranking import row_number
from tablelens.llm.common import ASCII_SPACE, salted_join, written

SEED = 20
UNIT = ["id", "source", "size"]


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(f"[^{ASCII_SPACE}]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of ``column``, nulls last: range partitions
    number their own rows, and only one count per partition is put in order."""
    parts = written(df.repartitionByRange(F.col(column).asc_nulls_last())
                    .withColumn("__part", F.spark_partition_id()), "ranked")
    own = Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last())
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (parts.withColumn("__own", F.row_number().over(own) - 1).join(counts, "__part")
            .withColumn("place", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, units, target): shares of ``share`` x all sizes by weight, stopped at ``most`` x
    the source's size, the excess reshared by weight. Each round is one aggregate over the sources."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src = written(ranked(src, "source").withColumn("weight", weight).drop("place"), "sources")
    total = (src.agg(F.sum("source_size")).first()[0] or 0) * share
    ceiling, level, stopped = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:  # the level only rises, and ends when no further source stops
        full = F.col("weight") * F.lit(level) >= ceiling
        held, rest, n = src.agg(F.sum(F.when(full, ceiling)), F.sum(F.when(~full, F.col("weight"))),
                                F.sum(full.cast("long"))).first()
        if not rest or n == stopped:
            break
        level, stopped = (total - (held or 0.0)) / rest, n
    return src.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling) if stopped >= 0 else ceiling).drop("weight")


def pivotal(size: np.ndarray, mass: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Pair by pair: 1 where a copy is won, 0 where lost; the one left over (-1: none) and its mass."""
    won = np.zeros(len(size), dtype=np.int8)
    held, held_mass = -1, 0.0
    for i, (s, m, u) in enumerate(zip(size.tolist(), mass.tolist(), draws.tolist())):
        if held < 0:
            held, held_mass = i, m
            continue
        room, other_room = float(size[held]) - held_mass, s - m
        up, down = min(room, m), min(held_mass, other_room)  # what the held one may gain or lose
        gains = u * (up + down) < down
        # one of the two is now empty or whole (told by the bound that was reached, not by rounded sums)
        if gains:
            a, b = held_mass + up, m - up
            done, whole = (held, True) if room <= m else (i, False)
        else:
            a, b = held_mass - down, m + down
            done, whole = (held, False) if held_mass <= other_room else (i, True)
        won[done] = whole
        if done == held:
            held, held_mass = i, b
        else:
            held_mass = a
    return won, held, held_mass


def _seeded(seed: int, *what) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr((seed, *what)).encode()))


def mix_copies(units: DataFrame, src: DataFrame, seed: int = SEED, bucket_rows: int = 8192, fan_in: int = 4096) -> DataFrame:
    """(id, source, size, rows, base, extra) of distinct units (with ``rows``, how many input rows each stands for):
    every row has ``base`` copies, and ``extra`` of them one more."""
    same = F.col("s.source").eqNullSafe(F.col("u.source"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (units.alias("u").join(src.alias("s"), same)
            .select("u.id", "u.source", "u.size", "u.rows", wanted.alias("wanted"), F.col("s.units").alias("n"))
            .withColumn("base", F.floor("wanted").cast("int"))
            .withColumn("due", (F.col("wanted") - F.col("base")) * F.col("rows"))  # extra copies of the unit
            .withColumn("sure", F.floor("due").cast("long"))
            .withColumn("part", F.col("due") - F.col("sure"))
            .withColumn("draw", F.pmod(F.xxhash64("id", "source", "size", F.lit(seed)), F.lit(1 << 40)))
            .withColumn("bucket", F.pmod(F.col("draw"), F.ceil(F.col("n") / bucket_rows).cast("long"))))
    rows = rows.withColumn("mass", F.col("part") * F.col("size"))
    paired = (F.col("size") > 0) & (F.col("part") > 0)
    own = [*UNIT, "rows", "base", "sure"]
    alone = rows.where(~paired).select(*own, (F.col("draw") / float(1 << 40) < F.col("part")).cast("int").alias("extra"))
    schema = "id long, source string, size long, rows long, base int, sure long, mass double, bucket long, extra int"
    state = rows.where(paired).select(*own, "mass", "bucket")

    def node(level):
        def decide(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["id", "size", "mass"], na_position="first", kind="stable", ignore_index=True)
            source, bucket = f["source"].iloc[0], int(f["bucket"].iloc[0])
            draws = _seeded(seed, level, None if pd.isna(source) else source, bucket)
            order = draws.permutation(len(f))
            f = f.iloc[order].reset_index(drop=True)
            won, left, mass = pivotal(f["size"].to_numpy(), f["mass"].to_numpy(), draws.random(len(f)))
            f["extra"] = won.astype("int32")
            if left >= 0:
                f.loc[left, "extra"] = -1
                f.loc[left, "mass"] = mass
            return f
        return decide

    done, level = [alone], 0
    while True:
        out = written(state.groupBy("source", "bucket").applyInPandas(node(level), schema), f"mix-{level}")
        done.append(out.where("extra >= 0").select(*own, "extra"))
        state = out.where("extra < 0").drop("extra")
        widest = state.agg(F.max("bucket")).first()[0]
        if not widest:  # one residual a source at most
            break
        state = state.withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
        level += 1
    draw = F.pmod(F.xxhash64("id", "source", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)
    done.append(state.select(*own, (draw * F.col("size") < F.col("mass")).cast("int").alias("extra")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*UNIT, "rows", "base", (F.col("sure") + F.col("extra")).alias("extra"))


def _keyed(df: DataFrame, source, id_, size) -> DataFrame:
    """``df`` with its unit as key columns without nulls."""
    return df.withColumns({"__i": F.coalesce(id_, F.lit(0).cast("long")), "__in": id_.isNull(), "__s": F.coalesce(source, F.lit("")),
                           "__sn": source.isNull(), "__z": size})


_KEYS = ["__i", "__in", "__s", "__sn", "__z"]


def _dealt(rows: DataFrame, copies: DataFrame, order: str) -> DataFrame:
    """``rows`` (with the key columns) with ``copies``: the extra copies of a unit go to its first rows in ``order``."""
    units = _keyed(copies, F.col("source"), F.col("id"), F.col("size")).select(*_KEYS, F.col("rows").alias("__rows"), "base", "extra")
    both = salted_join(rows, units, _KEYS, "__rows")
    single = both.where("__rows = 1").withColumn("copies", F.col("base") + F.col("extra"))
    if units.where("__rows > 1").isEmpty():
        return single.drop(*_KEYS, "__rows", "base", "extra")
    numbered = row_number(both.where("__rows > 1"), _KEYS, [order], "__place")
    many = numbered.withColumn("copies", F.col("base") + (F.col("__place") <= F.col("extra")).cast("int")).drop("__place")
    return single.unionByName(many).drop(*_KEYS, "__rows", "base", "extra")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per input row."""
    sizes = written(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                                word_count(text_col).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("__text")), "sizes")
    src, copies = _plan(sizes, weights, share, most, seed)
    rows = _dealt(_keyed(sizes, F.col("source"), F.col("id"), F.col("size")), copies, "__text").drop("__text")
    # no more sources than the join's other side has rows; a source of any share of the rows is split
    src = src.withColumns({"__s": F.coalesce("source", F.lit("")), "__sn": F.col("source").isNull()}).drop("source")
    rows = rows.withColumns({"__s": F.coalesce("source", F.lit("")), "__sn": F.col("source").isNull()})
    return (salted_join(rows, src, ["__s", "__sn"], "units")
            .select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def _plan(sizes: DataFrame, weights, share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    src = written(targets(sizes, weights, share, most), "targets")
    return src, written(mix_copies(sizes.groupBy(*UNIT).agg(F.count("*").alias("rows")), src, seed), "copies")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the input's rows and columns, each row as often as the mix takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("__text"))
    _, copies = _plan(written(rows.drop("__row", "__text"), "sizes"), weights, share, most, seed)
    taken = _dealt(_keyed(rows, F.col("source"), F.col("id"), F.col("size")), copies, "__text")
    return (taken.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
