"""Table readers (S1-S7): one entry point that dispatches on the file suffix.

All readers are Spark data sources. What decides how a file is read (encoding,
quoted line breaks, JSON form, cell types) is found over the whole input by a
distributed pass; only header lines reach the driver.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: supported suffixes and CSV sniffing candidates, in the reference's order
SUPPORTED = [".csv", ".xlsx", ".json", ".parquet", ".arff", ".tsv"]
SEPARATORS = [",", ";", "\t", "|"]
#: The cells that mean "missing" to a default CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
             "NaN", "None", "n/a", "nan", "null"]

_CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "latin-1": "iso-8859-1", "latin1": "iso-8859-1",
             "iso-8859-1": "iso-8859-1", "cp1252": "iso-8859-1", "windows-1252": "iso-8859-1"}
_CP1252 = {"cp1252", "windows-1252"}


def spark_charset(name: str) -> str:
    """The charset name Spark's CSV source accepts (cp1252 is read as latin-1, then ``_from_cp1252``)."""
    return _CHARSETS.get(name.lower(), name)


def _from_cp1252(c):
    """The characters that windows-1252 has where latin-1 has control codes."""
    codes = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(c, "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def _suffix(path: str) -> str:
    m = re.search(r"(\.[A-Za-z0-9]+)/*$", path)
    return m.group(1).lower() if m else ""


def load_dataset(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Read a table by suffix; unsupported suffixes raise with the supported list."""
    suf = _suffix(path)
    readers = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".parquet": read_parquet,
               ".arff": read_arff, ".xlsx": read_xlsx}
    if suf not in readers:
        raise ValueError(f"Unsupported file format: {suf or path}. Supported formats: {', '.join(SUPPORTED)}")
    return readers[suf](spark, path, **kw)


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """(separator, encoding, a quoted cell may span lines). The header line gives the separator: the first
    that splits it into more than one column. One distributed pass over all bytes tells whether they are
    UTF-8, and whether some line has an odd number of quotes."""
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    head = spark.read.text(path).limit(1).collect()
    valid, spans = lines.agg(F.min(F.is_valid_utf8("value")), F.max(odd)).first()
    header = head[0][0] if head else ""
    sep = next((x for x in SEPARATORS if len(header.split(x)) > 1), ",")
    return sep, "utf-8" if valid in (None, True) else "latin-1", bool(spans)


def infer_types(df: DataFrame) -> DataFrame:
    """String columns to the narrowest type that all their values parse as: long, double, boolean,
    timestamp, else string. One aggregate over the table."""
    def fits(c, kind):
        v = F.trim(F.col(f"`{c}`"))
        if kind == "boolean":
            return F.lower(v).isin("true", "false")
        if kind == "bigint":
            return v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()
        if kind == "double":
            return v.try_cast("double").isNotNull() & ~v.rlike(r"(?i)[df]$")
        return v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & v.try_cast("timestamp").isNotNull()
    kinds = ["bigint", "double", "boolean", "timestamp"]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    row = plain.agg(F.count(F.lit(1)), *[F.min(F.when(F.col(c).isNotNull(), fits(c, k))) for c in plain.columns for k in kinds]).first() if df.columns else None
    out = []
    for k, c in enumerate(df.columns):
        kind = next((t for m, t in enumerate(kinds) if row[1 + 4 * k + m]), "string")
        v = F.col(f"`{c}`")
        out.append((v if kind == "string" else F.trim(v).cast(kind)).alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             schema: T.StructType | str | None = None, multi_line: bool | None = None, na: list[str] | None = None, **kw) -> DataFrame:
    """Header CSV with separator/encoding sniffing and type inference (or an explicit schema).

    Quotes inside quoted cells are doubled. ``multi_line``: quoted cells may hold line breaks (files are
    then read whole, one task each); by default this is found out. ``na``: cells that are missing values,
    nulls before types are inferred."""
    if sep is None or encoding is None or multi_line is None:
        found = sniff_csv(spark, path)
        sep, encoding = sep or found[0], encoding or found[1]
        multi_line = found[2] if multi_line is None else multi_line
    r = (spark.read.option("header", True).option("sep", sep).option("encoding", spark_charset(encoding))
         .option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("inferSchema", False).option("mode", "PERMISSIVE"))
    for k, v in kw.items():
        r = r.option(k, v)
    df = r.csv(path)
    tokens = NA_TOKENS if na is None else na
    cell = (lambda c: _from_cp1252(F.col(f"`{c}`"))) if encoding.lower() in _CP1252 else (lambda c: F.col(f"`{c}`"))
    df = df.select(*[F.when(~cell(c).isin(tokens), cell(c)).alias(c) for c in df.columns])
    if schema is None:
        return infer_types(df)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, wanted.fields)])


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    """S3: tab-separated."""
    return read_csv(spark, path, sep="\t", encoding=kw.pop("encoding", "utf-8"), **kw)


def read_json(spark: SparkSession, path: str, schema=None, **kw) -> DataFrame:
    """JSON lines, an array of records, one (also pretty-printed) record, or a table by column
    (``{"a": [..], "b": [..]}`` or ``{"a": {"0": .., "1": ..}, ..}``); a directory may hold several of these.

    Lines are told from documents over the whole input: in lines, most lines are whole records (a damaged
    line makes no document of them). Documents are read one task a file, as they can't be cut."""
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    record = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    share = text.agg(F.avg(record.cast("int"))).first()[0]
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    documents = share is not None and share < 0.5
    df = r.json(path, multiLine=documents, **kw)
    return _by_column(spark, path, df, documents) if schema is None else df


def _one_object_a_file(spark: SparkSession, path: str, df: DataFrame, documents: bool) -> bool:
    """True if each file is one object: not lines, and not an array of records that have arrays."""
    per = df.select(F.col("_metadata.file_path").alias("f"), F.size(F.col(f"`{df.columns[0]}`")).alias("w"))
    most = per.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).agg(F.max("n"), F.max("w")).first()[0]
    if most != 1 or not documents:
        return most == 1
    root = F.regexp_extract("value", r"^\s*(\S)", 1)
    return not spark.read.text(path, wholetext=True).where(~root.isin("{", "")).limit(1).count()


def _by_column(spark: SparkSession, path: str, df: DataFrame, documents: bool) -> DataFrame:
    """Turn a table given by column into rows; other frames are returned as they are."""
    kinds = [f.dataType for f in df.schema.fields]
    if kinds and all(isinstance(k, T.ArrayType) for k in kinds):
        # a column that a document lacks is missing in its rows
        arrays = df.select(*[F.coalesce(F.col(f"`{c}`"), F.array().cast(t)).alias(f"c{k}") for k, (c, t) in enumerate(zip(df.columns, kinds))])
        if _one_object_a_file(spark, path, df, documents):
            zipped = arrays.select(F.explode(F.arrays_zip(*arrays.columns)).alias("r"))
            return zipped.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(df.columns)])
    if kinds and all(isinstance(k, T.StructType) for k in kinds) and all(f.name.isdigit() for k in kinds for f in k.fields):
        whole = spark.read.text(path, wholetext=True)
        values = [next(iter(k.fields)).dataType if k.fields else T.StringType() for k in kinds]
        record = T.StructType([T.StructField(c, T.MapType(T.StringType(), v)) for c, v in zip(df.columns, values)])
        maps = whole.select(F.from_json("value", record).alias("r")).select(*[F.col(f"r.`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
        keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(c) for c in maps.columns])))
        rows = maps.withColumn("k", F.explode(keys))
        return rows.select(*[F.element_at(f"c{k}", F.col("k")).alias(c) for k, c in enumerate(df.columns)])
    return df


def read_parquet(spark: SparkSession, path: str, **kw) -> DataFrame:
    """S5."""
    return spark.read.parquet(path)


_ARFF_ATTR = re.compile(r"^@attribute\s+('([^']*)'|\"([^\"]*)\"|(\S+))\s+(.+)$", re.IGNORECASE)


def _arff_fields(lines) -> tuple[list, bool]:
    fields, seen_data = [], False
    for line in lines:
        s = line.strip()
        if s.lower().startswith("@data"):
            seen_data = True
            break
        m = _ARFF_ATTR.match(s)
        if not m:
            continue
        name = m.group(2) or m.group(3) or m.group(4)
        typ = m.group(5).strip().lower()
        dt = T.DoubleType() if typ in ("numeric", "real", "integer") else T.StringType()
        fields.append(T.StructField(name, dt, True))
    return fields, seen_data


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)


def arff_schema(spark: SparkSession, path: str, peek_lines: int = 10_000) -> T.StructType:
    """Parse the ``@attribute`` lines into a schema (numeric -> double, others -> string).

    The header is normally within the first lines; if ``@data`` is not seen there
    (e.g. a directory whose header is a separate part) the attribute lines are
    filtered out of the whole text, keeping their order.
    """
    fields, seen = _arff_fields(r[0] for r in _text(spark, path).limit(peek_lines).collect())
    if not seen:
        attrs = _text(spark, path).where(F.lower(F.trim("value")).startswith("@attribute")).collect()
        fields, _ = _arff_fields(r[0] for r in attrs)
    if not fields:
        raise ValueError("No @attribute lines found in ARFF header")
    return T.StructType(fields)


def read_arff(spark: SparkSession, path: str, **kw) -> DataFrame:
    """ARFF; the body is parsed by ``from_csv`` on the executors, ``?`` is missing."""
    schema = arff_schema(spark, path)
    lines = _text(spark, path).where((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("%"))
    # a header line starts with one of the format's three words; any other "@..." line is data
    word = F.lower(F.regexp_extract(F.trim("value"), r"^(@\w+)(\s|$)", 1))
    body = lines.where(~word.isin("@relation", "@attribute", "@data"))
    parsed = body.select(F.from_csv(F.col("value"), schema.simpleString(),
                                    {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true",
                                     "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return parsed.select("r.*")


# ------------------------------------------------------------------ xlsx (stdlib zip + xml, no extra library)
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = "".join(ch for ch in ref if ch.isalpha())
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def parse_xlsx(content: bytes) -> list[list]:
    """Rows of the first worksheet as lists of str/float/None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        root = ET.fromstring(z.read(sheet))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        vals: dict[int, object] = {}
        for c in row.findall("m:c", _NS):
            idx = _col_index(c.get("r", "A1"))
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                vals[idx] = shared[int(v.text)]
            elif t == "inlineStr":
                vals[idx] = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t in ("str", "b") and v is not None:
                vals[idx] = v.text
            elif v is not None and v.text is not None:
                vals[idx] = float(v.text)
        width = max(vals) + 1 if vals else 0
        rows.append([vals.get(i) for i in range(width)])
    return rows


def _cell_str(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, float):
        return repr(int(v)) if v.is_integer() and abs(v) < 2 ** 53 else repr(v)
    return str(v)


def read_xlsx(spark: SparkSession, path: str, infer: bool = True, **kw) -> DataFrame:
    """S7 (re-aimed): a directory (or glob) of ``.xlsx`` workbooks, one task per workbook.

    Column names come from the first row of each workbook; all must have the same names, in any order
    (a workbook with others raises). Cells are read as strings; with ``infer`` a column whose every value
    parses as a number becomes double.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def heads(it):
        for pdf in it:
            yield pd.DataFrame({"header": [[str(h) for h in (parse_xlsx(bytes(c)) or [[]])[0]] for c in pdf["content"]], "path": pdf["path"]})

    first = files.select("path", "content").mapInPandas(heads, "header array<string>, path string").agg(F.min_by("header", "path")).first()[0]
    if first is None:
        raise ValueError("No .xlsx workbook found")
    header = list(first)
    schema = T.StructType([T.StructField(h, T.StringType(), True) for h in header])

    def parse(it):
        for pdf in it:
            for content in pdf["content"]:
                rows = parse_xlsx(bytes(content))
                names = [str(h) for h in rows[0]] if rows else header
                if sorted(names) != sorted(header):
                    raise ValueError(f"Workbook columns differ: {names} and {header}")
                places = [names.index(h) for h in header]
                out = [[_cell_str(r[p]) if p < len(r) else None for p in places] for r in rows[1:]]
                yield pd.DataFrame(out, columns=header)

    raw = files.select("content").mapInPandas(parse, schema)
    if not infer:
        return raw
    bad = raw.agg(*[F.sum(F.when(F.col(f"`{h}`").isNotNull() & F.col(f"`{h}`").try_cast("double").isNull(), 1)
                          .otherwise(0)).alias(h) for h in header]).first()
    return raw.select(*[F.col(f"`{h}`").cast("double").alias(h) if (bad[h] or 0) == 0 else F.col(f"`{h}`")
                        for h in header])
