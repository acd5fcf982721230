"""One-pass wide aggregation returned in long form (rule X1 of the design).

All per-column metrics of a table are computed by a single ``agg`` (partial
aggregation on every task, one tiny final merge) and the single result row is
exploded into one row per column -- no per-column jobs, no driver loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 60


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(c: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + c.replace("`", "``") + "`"


def wide_agg(df: DataFrame, cols: list[str], metrics: dict[str, Callable[[str], Column | str]]) -> DataFrame:
    """(column, ordinal, <metric...>) with one row per input column.

    ``metrics`` maps an output name to a function of the column name returning
    an aggregate expression, as a Column or as SQL text (cheaper to build).
    Columns are chunked so generated code stays small; each chunk is its own
    scan, which Spark prunes to the chunk's columns. Every metric of one name
    must have one type across columns (the rows are exploded from one array).
    """
    parts = []
    for start in range(0, len(cols), CHUNK):
        chunk = cols[start:start + CHUNK]
        exprs = []
        for i, c in enumerate(chunk):
            for m, fn in metrics.items():
                e = fn(c)
                exprs.append(F.expr(f"{e} AS `_{i}__{m}`") if isinstance(e, str) else e.alias(f"_{i}__{m}"))
        row = df.agg(*exprs)
        structs = ", ".join(
            f"named_struct('column', {_lit(c)}, 'ordinal', {start + i}, "
            + ", ".join(f"'{m}', `_{i}__{m}`" for m in metrics) + ")"
            for i, c in enumerate(chunk))
        parts.append(row.selectExpr(f"inline(array({structs}))"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def val_sql(df: DataFrame, c: str) -> str:
    """SQL text of a column as double, NaN read as NULL."""
    from pyspark.sql import types as T
    x = f"CAST({_name(c)} AS DOUBLE)"
    return f"nanvl({x}, CAST(NULL AS DOUBLE))" if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x


def missing_sql(df: DataFrame, c: str) -> str:
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return f"({_name(c)} IS NULL OR isnan({_name(c)}))"
    return f"({_name(c)} IS NULL)"
