"""Global orders without a single task (rule X2): running sums and row numbers.

``Window.orderBy`` without ``partitionBy`` (or with a partition that can hold
most of the table) moves every row into one task. Instead, at every size:

1. range-partition on (group, order); each partition is a slice of the order.
   The slices are written once to the shared scratch folder, because range
   bounds come from a sample and must not be drawn again;
2. a window over (slice, group) sums inside each slice;
3. per-(slice, group) totals -- at most #slices + #groups rows -- are summed
   over the slices before, and joined back (the planner picks the join).

A group of any size is spread over slices. NULL values add nothing, NULL
group keys are a group like any other, and totals may be negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import scratch_path


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<v>`` = inclusive running sum of each value column within each group, in order.

    ``order_cols`` must make the order total within a group for a deterministic result.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in [*group_cols, *order_cols]]
    path = scratch_path(spark, "slices")
    df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    sliced = spark.read.parquet(path)
    groups = [F.col(f"`{g}`") for g in group_cols]
    inside = (Window.partitionBy("_pid", *groups).orderBy(*[F.col(f"`{c}`") for c in order_cols])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sliced.select("*", *[F.coalesce(F.sum(f"`{v}`").over(inside), F.lit(0)).alias(f"_loc_{v}") for v in value_cols])
    totals = sliced.groupBy("_pid", *groups).agg(*[F.sum(f"`{v}`").alias(f"_tot_{v}") for v in value_cols])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("_pid").alias("_p"), *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group_cols)],
                         *[F.coalesce(F.sum(f"_tot_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group_cols):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    return local.join(offs, same).select(*[F.col(f"`{c}`") for c in df.columns], *[
        (F.col(f"`_loc_{v}`") + F.col(f"`_off_{v}`")).cast(df.schema[v].dataType).alias(f"cum_{v}") for v in value_cols])


def row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "rn",
               num_partitions: int | None = None) -> DataFrame:
    """1-based row number within each group by ``order_cols`` (which must be a total order)."""
    with_one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(with_one, group_cols, order_cols, ["_one"], num_partitions).withColumnRenamed("cum__one", out).drop("_one")


def sorted_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "rn",
                      num_partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row_number`` whose slices are sorted and numbered as they are written: rows are shuffled once, and only the
    columns ``keep`` (all) go on. Rows come out slice by slice, not in the order of ``row_number``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in [*group_cols, *order_cols]]
    kept = [c for c in df.columns if keep is None or c in keep]
    path = scratch_path(spark, "slices")
    (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
     .select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, *group_cols])], F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at"))
     .write.parquet(path))
    sliced = spark.read.parquet(path)
    groups = [F.col(f"`{g}`") for g in group_cols]
    totals = sliced.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("_pid").alias("_p"), *[g.alias(f"_g{i}") for i, g in enumerate(groups)],
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"_g{i}"))
    if not groups:
        offs = F.broadcast(offs)  # a row per slice
    return sliced.join(offs, same).select(*[F.col(f"`{c}`") for c in kept], (F.col("_at") + F.col("_off")).cast("long").alias(out))
