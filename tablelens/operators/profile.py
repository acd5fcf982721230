"""Data-quality profile: shape, missing values, duplicates, distinct counts, flags.

Every function takes a DataFrame and returns a small result DataFrame. The
expensive parts are one wide aggregate (nulls, sizes) and one value-frequency
table (distinct counts, modes, top values); both are map-side combined, so a hot
value never lands whole on one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import (
    kind_of,
    missing_flag,
    profiled_columns,
    string_long,
)
from tablelens.functions.numfmt import sig
from tablelens.functions.wide import missing_sql, wide_agg

_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("Cannot analyze empty dataset")


def shape(df: DataFrame) -> DataFrame:
    """A1: (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def value_frequencies(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A0: (column, value string, n) over non-missing cells; shared by distinct/mode/top-k."""
    cols = cols or profiled_columns(df)
    return string_long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: (column, ordinal, null_count, n_rows). NaN counts as missing."""
    cols = cols or df.columns
    return wide_agg(df, cols, {
        "null_count": lambda c: f"count(CASE WHEN {missing_sql(df, c)} THEN 1 END)",
        "n_rows": lambda c: "count(1)",
    })


def missing_pct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: (column, null_count, missing_pct, has_missing)."""
    nc = null_counts(df, cols)
    return nc.select(
        "column", "ordinal", "null_count",
        sig(F.try_divide(F.col("null_count") * 100.0, F.col("n_rows"))).alias("missing_pct"),
        (F.col("null_count") > 0).alias("has_missing"))


def total_missing(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("null_count").alias("total_missing"))


def missing_patterns(df: DataFrame, top: int = 10) -> DataFrame:
    """A4: the most frequent null masks, as a 0/1 string in column order."""
    flags = [F.when(missing_flag(df, c), F.lit("1")).otherwise(F.lit("0")) for c in df.columns]
    pat = df.select(F.concat(*flags).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return pat.orderBy(F.desc("n"), "pattern").limit(top)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A5: rows that repeat an earlier row (all columns equal, NULLs equal).

    One shuffle: group on the whole row (map-side combined, so repeated rows
    collapse before the exchange), then count groups and sum their sizes.
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).select(
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "n_distinct",
        (F.coalesce("n_rows", F.lit(0)) - F.col("n_distinct")).cast("long").alias("duplicate_rows"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_count) of non-missing values. Exact through A0; ``approx`` uses HLL++."""
    cols = cols or profiled_columns(df)
    if approx:
        return wide_agg(df, cols, {"unique_count": lambda c: F.approx_count_distinct(F.col(f"`{c}`")).cast("long")}) \
            .select("column", "unique_count")
    freq = value_frequencies(df, cols)
    seen = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    allc = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return allc.join(seen, "column", "left").select("column", F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"))


def _id_name(col: F.Column) -> F.Column:
    low = F.lower(col)
    return low.isin("id", "index", "key") | low.contains("id")


def column_flags(df: DataFrame) -> DataFrame:
    """Constant / high-cardinality / potential-id flags per column."""
    dc = distinct_counts(df, df.columns)
    n = null_counts(df).select("column", "n_rows")
    return dc.join(n, "column").select(
        "column", "unique_count",
        (F.col("unique_count") <= 1).alias("is_constant"),
        ((F.try_divide(F.col("unique_count"), F.col("n_rows")) > 0.9) & (F.col("unique_count") > 100)).alias("is_high_cardinality"),
        ((F.col("unique_count") == F.col("n_rows")) | _id_name(F.col("column"))).alias("is_potential_id"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row per column -- dtype, nulls, distinct count, flags (the upload profile)."""
    _require_rows(df)
    types = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column string, ordinal int, dtype string, kind string")
    nc = null_counts(df).select("column", "null_count", "n_rows")
    flags = column_flags(df)
    return (
        types.join(nc, "column").join(flags, "column")
        .select("column", "ordinal", "dtype", "kind", "null_count",
                sig(F.col("null_count") * 100.0 / F.col("n_rows")).alias("null_percentage"),
                "unique_count", "is_constant", "is_high_cardinality", "is_potential_id")
    )


def logical_bytes(df: DataFrame) -> DataFrame:
    """A28 (re-aimed): logical bytes per column -- fixed width x rows, or UTF-8 bytes of strings."""
    def metric(c: str):
        dt = df.schema[c].dataType
        for t, w in _FIXED_WIDTH.items():
            if isinstance(dt, t):
                return (F.count(F.lit(1)) * w).cast("long")
        if isinstance(dt, T.DecimalType):
            return (F.count(F.lit(1)) * 16).cast("long")
        return F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)).cast("long")
    return wide_agg(df, df.columns, {"bytes": metric}).select("column", "ordinal", "bytes")


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type (from the schema)."""
    rows = {}
    for f in df.schema.fields:
        rows[f.dataType.simpleString()] = rows.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(rows.items()), "dtype string, n_columns long")


def quality_score(df: DataFrame) -> DataFrame:
    """max(0, 100 - missing cells / all cells * 100)."""
    nc = null_counts(df)
    return nc.agg(F.sum("null_count").alias("missing"), F.sum("n_rows").alias("cells")).select(
        "missing", "cells",
        sig(F.greatest(F.lit(0.0), F.lit(100.0) - F.try_divide(F.col("missing") * 100.0, F.col("cells")))).alias("quality_score"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top-k values per column by (count desc, value asc); limited per task before the shuffle."""
    freq = value_frequencies(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_values(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """K smallest distinct non-missing values per column (string order), deterministic."""
    freq = value_frequencies(df, cols)
    w = Window.partitionBy("column").orderBy("value")
    ranked = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("column", "rank", "value")


def worst_missing(df: DataFrame, k: int = 15) -> DataFrame:
    """T5: columns with missing values, highest percentage first."""
    mp = missing_pct(df)
    return mp.where(F.col("null_count") > 0).orderBy(F.desc("missing_pct"), "ordinal").limit(k).select(
        "column", "null_count", "missing_pct")


def preview_head(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First n rows in key order (top-k, no global sort)."""
    return df.orderBy(*order_by).limit(n)


def schema_listing(df: DataFrame, order_by: list[str], k: int = 3) -> DataFrame:
    """Name, dtype and the first k values (in key order) of every column."""
    head = df.orderBy(*order_by).limit(k).withColumn("_pos", F.monotonically_increasing_id())
    cols = df.columns
    long = head.select("_pos", *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(
        ["_pos"], cols, "column", "value")
    agg = long.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "value"))), lambda s: s["value"]), ", ")
        .alias("first_values"))
    types = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "column string, ordinal int, dtype string")
    return types.join(agg, "column", "left")


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, ordinal, dtype, kind) with kind in numeric/categorical/datetime/boolean/other."""
    return df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column string, ordinal int, dtype string, kind string")
