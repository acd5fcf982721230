"""Deterministic train/test splits and CV folds (M1-M4, M8).

Membership is decided by the order of ``md5(seed || '|' || key)``: reproducible
across runs, engines (DuckDB computes the same digest) and executor retries.
A split compares each row's hash with the hash at the wanted rank, which comes
from bracketed selection: the table is neither sorted nor written. Folds need
every row's rank, from the distributed row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.ranking import row_number
from tablelens.functions.selection import select_ranks
from tablelens.operators.profile import distinct_counts
from tablelens.session import scratch_path


def hash_key(key_cols: list[str], seed: int = 42) -> Column:
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key_cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _hash_value(h: Column) -> Column:
    """The hash's leading 52 bits, exact as a double and in the hash's order."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double")


def _first_by_hash(df: DataFrame, key_cols: list[str], group: Column, wanted, share: float, seed: int) -> DataFrame:
    """``df`` with ``split``: in each group (a string column) the first ``wanted(N)`` rows by hash, then keys, are test."""
    h = df.withColumn("_h", hash_key(key_cols, seed))
    h = h.withColumns({"_u": _hash_value(F.col("_h")), "_g": group})
    rank = lambda n, p: (F.greatest(wanted(n) - 1, F.lit(0)),) * 2
    cut = select_ranks(h.select(F.col("_g").alias("column"), F.col("_u").alias("value")), [share], rank)
    cut = cut.select(F.col("column").alias("_c"), F.col("v_hi").alias("_cut"), "before", "ties", wanted(F.col("N")).alias("_k"))
    path = scratch_path(df.sparkSession, "cuts")
    cut.write.parquet(path)  # a row per group
    cut = df.sparkSession.read.parquet(path)
    both = h.join(cut, F.col("_g") == F.col("_c"))
    some = (F.col("_k") > F.col("before")) & (F.col("_k") < F.col("before") + F.col("ties"))  # the cut runs through equal hashes
    first = (F.col("_u") < F.col("_cut")) | ((F.col("_u") == F.col("_cut")) & (F.col("_k") > F.col("before")))
    split = F.when((F.col("_k") > 0) & first, "test").otherwise("train")
    if cut.where(some).isEmpty():
        return both.withColumn("split", split).select(*[F.col(f"`{c}`") for c in df.columns], "split")
    tied = some & (F.col("_u") == F.col("_cut"))
    rest = both.where(~tied).withColumn("split", split)
    ranked = row_number(both.where(tied), ["_g"], ["_h", *key_cols], "_rn")
    ties = ranked.withColumn("split", F.when(F.col("before") + F.col("_rn") <= F.col("_k"), "test").otherwise("train"))
    keep = [*df.columns, "split"]
    return rest.select(*[F.col(f"`{c}`") for c in keep]).union(ties.select(*[F.col(f"`{c}`") for c in keep]))


def split_random(df: DataFrame, key_cols: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` in {'train','test'}: the first ceil(n * test_size) rows by hash go to test."""
    return _first_by_hash(df, key_cols, F.lit("all"), lambda n: F.ceil(n * F.lit(test_size)), test_size, seed)


def adjusted_test_size(n: int, k: int, test_size: float) -> float:
    """Stratified fallback from the reference: shrink test_size when classes would not fit."""
    if n > 0 and test_size > (n - k) / n:
        return max(0.1, (n - k) / n - 0.05)
    return test_size


def split_stratified(df: DataFrame, key_cols: list[str], target: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per class, the first round(n_c * test_size) rows by hash go to test.

    As in the reference, a test share that would leave fewer training rows than
    classes is reduced to max(0.1, (n - k) / n - 0.05).
    """
    counts = df.groupBy(F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    test_size = adjusted_test_size(tot["n"] or 0, tot["k"] or 0, test_size)
    # a class's name, apart from that of the missing class
    group = F.concat(F.when(F.col(f"`{target}`").isNull(), "-").otherwise("+"), F.coalesce(F.col(f"`{target}`").cast("string"), F.lit("")))
    return _first_by_hash(df, key_cols, group, lambda n: F.round(n * F.lit(test_size)), test_size, seed)


def cv_fold_count(train: DataFrame, target: str | None, classification: bool = True) -> DataFrame:
    """M3: folds = max(2, min(5, smallest train class, n_train // 10)); regression drops the class term."""
    if classification and target:
        per = train.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
        s = per.agg(F.sum("c").cast("long").alias("n_train"),
                    F.min(F.when(F.col(target).isNotNull(), F.col("c"))).alias("smallest_class"))
        return s.select("n_train", "smallest_class", F.greatest(
            F.lit(2), F.least(F.lit(5), F.col("smallest_class"), F.floor(F.col("n_train") / 10))).cast("int").alias("cv_folds"))
    n = train.agg(F.count(F.lit(1)).alias("n_train"))
    return n.select("n_train", F.lit(None).cast("long").alias("smallest_class"),
                    F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("n_train") / 10))).cast("int").alias("cv_folds"))


def cv_folds(df: DataFrame, key_cols: list[str], k: int, target: str | None = None, seed: int = 42) -> DataFrame:
    """M4: ``fold`` = (rank within class by hash - 1) % k (stratified), or over all rows."""
    h = df.withColumn("_h", hash_key(key_cols, seed + 1))
    ranked = row_number(h, [target] if target else [], ["_h", *key_cols], "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def infer_task_type(df: DataFrame, target: str) -> DataFrame:
    """M8: string target or fewer than 20 distinct values -> classification, else regression."""
    is_str = str(df.schema[target].dataType.simpleString()) == "string"
    dc = distinct_counts(df, [target])
    return dc.select(
        F.col("column").alias("target"), "unique_count",
        F.when(F.lit(is_str) | (F.col("unique_count") < 20), "classification").otherwise("regression").alias("task_type"))
