"""Column-kind helpers (P1, A29) and the long-format reshapes every profile builds on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


def kind_of(dt: T.DataType) -> str:
    """Map a Spark type to the reference's three analysed kinds (plus boolean / other)."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, _NUMERIC):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame, exclude: tuple | list = ()) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric" and f.name not in exclude]


def categorical_columns(df: DataFrame, include_bool: bool = False, exclude: tuple | list = ()) -> list[str]:
    kinds = {"categorical", "boolean"} if include_bool else {"categorical"}
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds and f.name not in exclude]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "datetime"]


def profiled_columns(df: DataFrame) -> list[str]:
    """Columns with a scalar kind; nested/binary columns are not profiled."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) != "other"]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _FLOATING)


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN mapped to NULL (pandas treats NaN as missing; Spark does not)."""
    c = F.col("`" + name.replace("`", "``") + "`")
    if is_floating(df, name):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def missing_flag(df: DataFrame, name: str) -> Column:
    c = F.col("`" + name.replace("`", "``") + "`")
    if is_floating(df, name):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalize_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (one projection, no shuffle)."""
    return df.select([clean_value(df, f.name).alias(f.name) for f in df.schema.fields])


def numeric_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value double) for every non-missing numeric cell."""
    wide = df.select([clean_value(df, c).cast("double").alias(c) for c in cols])
    return (
        wide.unpivot([], cols, "column", "value")
        .where(F.col("value").isNotNull())
    )


def string_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value string) for every non-missing cell of the given columns."""
    wide = df.select([clean_value(df, c).cast("string").alias(c) for c in cols])
    return (
        wide.unpivot([], cols, "column", "value")
        .where(F.col("value").isNotNull())
    )


def ordinal_table(spark, cols: list[str]) -> DataFrame:
    """(column, ordinal) for a list of column names; size is bounded by the schema width."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, ordinal int")
