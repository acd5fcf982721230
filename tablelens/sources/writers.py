"""Sinks (S11, S12) and the writers used for format round trips.

Tables are written by Spark's own writers. ARFF is a header (one small text
file) plus a body written as text by the executors; workbooks are produced one
per partition inside the tasks and written by Spark's text sink, so through its
commit protocol and on any file system.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",", encoding: str = "utf-8") -> str:
    """Write a (preprocessed) table; CSV/TSV carry a header and no index."""
    from tablelens.sources.readers import spark_charset
    encoding = spark_charset(encoding)
    w = df.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if fmt == "tsv" else sep).option("encoding", encoding)
        # quotes are doubled and white space at the ends of cells stays
        w.option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported sink format {fmt}")
    return path


def write_arff(df: DataFrame, path: str, relation: str = "table", quoted: bool = True) -> str:
    """ARFF: a ``header`` part plus ``body`` parts in one directory (read back as one table). Without
    ``quoted`` strings are written bare, for values without commas, quotes and blanks."""
    spark = df.sparkSession
    lines = [f"@relation {relation}"]
    for f in df.schema.fields:
        numeric = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))
        lines.append(f"@attribute '{f.name}' {'numeric' if numeric else 'string'}")
    lines.append("@data")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")

    def cell(c: str, dt):
        v = F.col(f"`{c}`").cast("string")
        if quoted and isinstance(dt, T.StringType):
            v = F.concat(F.lit("'"), F.regexp_replace(v, "'", "\\\\'"), F.lit("'"))
        return F.coalesce(v, F.lit("?"))

    body = df.select(F.concat_ws(",", *[cell(f.name, f.dataType) for f in df.schema.fields]).alias("value"))
    body.write.mode("overwrite").text(f"{path}/body")
    return path


#: Fixed: the rows that a workbook holds, about.
WORKBOOK_ROWS = 10_000


def _xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    """A workbook; its last byte, the archive's comment, is the line separator of the text sink."""
    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{repr(float(v)) if isinstance(v, float) else v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def col(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    xml_rows = []
    for ri, r in enumerate([header] + rows, start=1):
        xml_rows.append(f'<row r="{ri}">' + "".join(cell(f"{col(ci)}{ri}", v) for ci, v in enumerate(r)) + "</row>")
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             f'<sheetData>{"".join(xml_rows)}</sheetData></worksheet>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        z.writestr("xl/workbook.xml",
                   '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.comment = b"\n"
    return buf.getvalue()


def write_xlsx_dir(df: DataFrame, path: str, workbooks: int | None = None) -> str:
    """One workbook per partition (``part-<n>...xlsx``) in ``path``; returns the directory. ``workbooks``:
    by default as many as the rows need, at about ``WORKBOOK_ROWS`` each."""
    header = df.columns
    if workbooks is None:
        workbooks = max(1, -(-df.count() // WORKBOOK_ROWS))

    def write(it):
        rows = []
        for pdf in it:
            rows.extend(pdf.astype(object).where(pd.notna(pdf), None).values.tolist())
        yield pd.DataFrame({"value": [_xlsx_bytes(header, rows)[:-1]]})  # the sink adds the last byte

    (df.repartition(workbooks).mapInPandas(write, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", "\n").option("compression", "none").text(path))
    # the sink's files end in .txt; names are changed once all are committed
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")):
        name = found.getPath()
        if not fs.rename(name, spark._jvm.org.apache.hadoop.fs.Path(folder, name.getName().removesuffix(".txt") + ".xlsx")):
            raise OSError(f"{name} could not be named .xlsx")
    return path


def write_report_json(report: DataFrame, path: str) -> str:
    """The long-format report rows as JSON lines (one record per row)."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)
    return path
