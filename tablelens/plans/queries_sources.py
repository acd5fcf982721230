"""Catalog entries: readers and sinks as round trips (write a driver table, read it back through the loader).

Round-trip files go under the session's shared scratch folder. The read-back
frame is cast to the source schema, so the oracle is the source table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import prep, profile
from tablelens.plans.catalog import ORDERS_NULLS_COLS, ORDERS_NULLS_SQL, orders_nulls, register, table
from tablelens.session import scratch_path
from tablelens.sources import readers, writers


def _as(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema.fields])


register("load_parquet", "SELECT * FROM orders")(
    lambda s, d: readers.load_dataset(s, f"{d.rstrip('/')}/orders.parquet"))


def _csv_sniff(s, d):
    src = table(s, d, "orders")
    path = scratch_path(s, "orders") + ".csv"
    writers.write_table(src, path, "csv", sep=";", encoding="latin1")
    return _as(readers.load_dataset(s, path), src)


register("load_csv_sniff", "SELECT * FROM orders")(_csv_sniff)


def _tsv(s, d):
    src = table(s, d, "customer")
    path = scratch_path(s, "customer") + ".tsv"
    writers.write_table(src, path, "tsv")
    return _as(readers.load_dataset(s, path), src)


register("load_tsv", "SELECT * FROM customer")(_tsv)


def _json(s, d):
    src = table(s, d, "part")
    path = scratch_path(s, "part") + ".json"
    writers.write_table(src, path, "json")
    return _as(readers.load_dataset(s, path), src)


register("load_json", "SELECT * FROM part")(_json)


def _arff(s, d):
    src = table(s, d, "customer")
    path = scratch_path(s, "customer") + ".arff"
    writers.write_arff(src, path, "customer")
    return _as(readers.load_dataset(s, path), src)


register("load_arff", "SELECT * FROM customer")(_arff)


def _xlsx(s, d):
    src = table(s, d, "supplier")
    path = scratch_path(s, "supplier") + ".xlsx"
    writers.write_xlsx_dir(src, path)
    return _as(readers.load_dataset(s, path), src)


register("load_xlsx_dir", "SELECT * FROM supplier")(_xlsx)


def _csv_quoted(s, d):
    """Texts with quotes and line breaks, through a CSV file and back (quotes are added, as few texts have any)."""
    src = table(s, d, "documents").select("doc_id", F.concat(F.lit('say "'), "text", F.lit('", ok\n"end"')).alias("text"), "lang")
    path = scratch_path(s, "quoted") + ".csv"
    writers.write_table(src, path, "csv")
    return _as(readers.load_dataset(s, path), src)


register("load_csv_quoted", """SELECT doc_id, 'say "' || text || '", ok' || chr(10) || '"end"' AS text, lang FROM documents""")(_csv_quoted)


def _csv_late_bytes(s, d):
    """A latin-1 file whose first lines are ASCII only: the rows are in the order of their language."""
    src = table(s, d, "documents").select("doc_id", "lang", F.regexp_replace("text", "[^\\x00-\\xff]", "?").alias("text"))
    path = scratch_path(s, "late") + ".csv"
    ordered = src.orderBy(F.col("lang") != "en", "doc_id")
    writers.write_table(ordered, path, "csv", encoding="latin1")
    return _as(readers.load_dataset(s, path), src)


register("load_csv_late_bytes", "SELECT doc_id, lang, regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') AS text FROM documents")(_csv_late_bytes)


def _csv_na(s, d):
    """Missing cells spelt in several ways; numbers stay numbers."""
    key = F.col("c_custkey")
    src = table(s, d, "customer")
    spelt = src.select("c_custkey", F.when(key % 7 == 0, "NA").when(key % 7 == 1, "null").otherwise(F.col("c_name")).alias("c_name"),
                       F.when(key % 5 == 0, "N/A").when(key % 5 == 1, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    path = scratch_path(s, "missing") + ".csv"
    writers.write_table(spelt, path, "csv")
    got = readers.load_dataset(s, path)
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", F.lit(dict(got.dtypes)["c_acctbal"]).alias("kind"))


register("load_csv_na", """SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN c_name END AS c_name,
  CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS c_acctbal, 'double' AS kind FROM customer""")(_csv_na)


#: Fixed: the rows that a JSON document holds, about.
DOCUMENT_ROWS = 10_000


def _write_documents(src: DataFrame, path: str, document) -> None:
    """Documents of about ``DOCUMENT_ROWS`` rows each, as many as the rows need, one a file."""
    rows = src.count()
    dealt = src.repartition(max(1, -(-rows // DOCUMENT_ROWS))).withColumn("__doc", F.spark_partition_id())
    (dealt.groupBy("__doc") if rows else src.groupBy()).agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def _json_object(s, d):
    """Arrays of pretty-printed records."""
    src = table(s, d, "supplier")
    path = scratch_path(s, "objects") + ".json"
    record = F.to_json(F.struct(*src.columns), {"pretty": "true"})
    _write_documents(src, path, F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")))
    return _as(readers.load_dataset(s, path), src)


register("load_json_object", "SELECT * FROM supplier")(_json_object)


def _json_columns(s, d):
    """A table by column: documents of arrays."""
    src = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    path = scratch_path(s, "columns") + ".json"
    rows = F.sort_array(F.collect_list(F.struct(*src.columns)))
    _write_documents(src, path, F.to_json(F.struct(*[rows[c].alias(c) for c in src.columns]), {"pretty": "true"}))
    return _as(readers.load_dataset(s, path), src)


register("load_json_columns", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")(_json_columns)


def _arff_at(s, d):
    """Data lines that begin with @."""
    src = table(s, d, "customer").select(F.concat(F.lit("@"), "c_name").alias("handle"), "c_custkey", "c_mktsegment")
    path = scratch_path(s, "handles") + ".arff"
    writers.write_arff(src, path, "handles", quoted=False)
    return _as(readers.load_dataset(s, path), src)


register("load_arff_at", "SELECT '@' || c_name AS handle, c_custkey, c_mktsegment FROM customer")(_arff_at)


def _dispatch(s, d):
    src = table(s, d, "nation")
    base = scratch_path(s, "nation")
    out = None
    for fmt in ["csv", "tsv", "json", "parquet", "arff"]:
        path = f"{base}.{fmt}"
        if fmt == "arff":
            writers.write_arff(src, path, "nation")
        else:
            writers.write_table(src, path, fmt)
        part = _as(readers.load_dataset(s, path), src).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


register("load_dispatch", "\nUNION ALL\n".join(
    f"SELECT *, '{fmt}' AS format FROM nation" for fmt in ["csv", "tsv", "json", "parquet", "arff"]))(_dispatch)


def _sink_processed(s, d):
    clean = prep.drop_constant(orders_nulls(s, d))
    path = scratch_path(s, "processed") + ".csv"
    writers.write_table(clean, path, "csv")
    return _as(readers.load_dataset(s, path), clean)


register("sink_processed", f"SELECT {', '.join(c for c, _ in ORDERS_NULLS_COLS if c != 'k')} FROM {ORDERS_NULLS_SQL}")(
    _sink_processed)


def _sink_report(s, d):
    rep = profile.quality_report(orders_nulls(s, d))
    path = scratch_path(s, "report") + ".json"
    writers.write_report_json(rep, path)
    return s.read.json(path)


register("sink_report_json")(_sink_report)


# ---------------------------------------------------------------- composite entry points
def _profile_facade(s, d):
    from tablelens.plans import facade
    return facade.profile_table(orders_nulls(s, d), ["o_orderkey"])["quality_report"]


def _eda_report(s, d):
    from tablelens.plans import facade
    return facade.report(orders_nulls(s, d), "o_orderstatus")


register("profile_facade")(_profile_facade)
register("eda_report")(_eda_report)
