"""Small shared pieces: table access, written intermediates, row multiplicities, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import scratch_path

#: ASCII white space, the only separators of "words" in the contracts.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: lineage is cut there, so a lost
    executor costs a read and nothing upstream is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that Spark may send to every task; as a hashed table each takes some hundred bytes of the driver.
SENT_ROWS = 100_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that must not be broadcast: Spark sizes a table by its packed files and an explode by
    what goes in, so tens of times too low. ``rows``: where known, small tables are left to Spark."""
    return df if rows is not None and rows <= SENT_ROWS else df.hint("merge")


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, how: str = "inner", most: int = 1000) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key; ``weight``: how many of ``rows`` have it), hot keys split.
    Keys with more than a ``most``-th of all rows are salted: fewer than ``most`` keys, so their list is broadcast.
    Their rows are dealt over as many salts as they fill such shares, and their row of ``side`` goes to each."""
    total, n = side.agg(F.sum(weight), F.count(F.lit(1))).first()
    share = max(64, -(-(total or 0) // most))
    hot = side.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("long").alias("__salts"))
    place = F.xxhash64(F.monotonically_increasing_id(), *keys)
    salted = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(place, F.coalesce("__salts", F.lit(1)))).cast("long")).drop("__salts"))
    salts = F.sequence(F.lit(0).cast("long"), F.when(F.col(weight) > share, F.ceil(F.col(weight) / share).cast("long") - 1).otherwise(0))
    return salted.join(dealt(side.withColumn("__salt", F.explode(salts)), n), [*keys, "__salt"], how).drop("__salt")


def text_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the columns an operator needs, the text as UTF-8 bytes (null: empty)."""
    return df.select(*[F.col(f"`{k}`") for k in keep],
                     F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("__text"))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        lens = pa.compute.binary_length(col).to_pylist()
        start = size = 0
        for i, n in enumerate(lens):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < len(lens):
            yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  (pa.compute)
