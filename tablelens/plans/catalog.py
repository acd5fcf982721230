"""Query catalog: every operator applied to the driver tables, with its DuckDB oracle.

``QUERIES[key] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Each query reads whole tables (or frames Spark derives from them row by row);
none filters or caps rows. Column names and types match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.numfmt import sig_sql as S

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def R(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits})"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------------------
# driver-table schemas (Spark simpleString) used to spell the oracle's dtype text
SCHEMAS = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
}
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


# ---------------------------------------------------------------------------
# the profile frame: orders with derived missing values and a constant column
# (driver tables hold no NULLs; the same CASE expressions run in Spark and DuckDB)
ORDERS_NULLS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                     ("o_totalprice", "double"), ("price_m5", "double"), ("price_m20", "double"),
                     ("price_m60", "double"), ("prio_m10", "string"), ("o_orderpriority", "string"), ("k", "string")]
ORDERS_NULLS_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice END AS price_m5,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price_m20,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_totalprice END AS price_m60,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS prio_m10,
  o_orderpriority, 'x' AS k FROM orders)"""


def orders_nulls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(key % 20 == 0, None).otherwise(F.col("o_totalprice")).alias("price_m5"),
        F.when(key % 5 == 0, None).otherwise(F.col("o_totalprice")).alias("price_m20"),
        F.when(key % 5 < 3, None).otherwise(F.col("o_totalprice")).alias("price_m60"),
        F.when(key % 10 == 0, None).otherwise(F.col("o_orderpriority")).alias("prio_m10"),
        "o_orderpriority", F.lit("x").alias("k"))


def _kind(dtype: str) -> str:
    if dtype in ("bigint", "int", "double", "float", "smallint", "tinyint") or dtype.startswith("decimal"):
        return "numeric"
    if dtype == "string":
        return "categorical"
    if dtype in ("timestamp", "date", "timestamp_ntz"):
        return "datetime"
    if dtype == "boolean":
        return "boolean"
    return "other"


def _profiled(cols):
    return [(c, t) for c, t in cols if _kind(t) != "other"]


from tablelens.plans import queries_profile  # noqa: E402,F401  (registers keys)
from tablelens.plans import queries_prep  # noqa: E402,F401
from tablelens.plans import queries_charts  # noqa: E402,F401
from tablelens.plans import queries_ml  # noqa: E402,F401
from tablelens.plans import queries_sources  # noqa: E402,F401
