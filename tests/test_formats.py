"""File-format samples (FIXTURES.md F5), written to a fresh scratch folder."""

import json
import os

import pytest

from tablelens.session import scratch_path
from tablelens.sources import readers, writers

F1_CSV = "id,age,income,score,target\n" + "\n".join(
    f"{i},{a},{inc},{s},{t}" for i, a, inc, s, t in [
        (1, 25, 50000, 80, "A"), (2, 35, 60000, 85, "B"), (3, 45, 70000, 90, "A"), (4, 22, 45000, 75, "B"),
        (5, 50, 90000, 95, "A")]) + "\n"


def _write(spark, name, text, encoding="utf-8"):
    path = scratch_path(spark, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(text.encode(encoding))
    return path


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separators(spark, sep):
    path = _write(spark, "f1.csv", F1_CSV.replace(",", sep)) + ""
    os.rename(path, path + ".csv")
    df = readers.load_dataset(spark, path + ".csv")
    assert df.columns == ["id", "age", "income", "score", "target"]
    assert df.count() == 5 and dict(df.dtypes)["income"] in ("int", "bigint")


def test_csv_latin1(spark):
    path = _write(spark, "lat", "name;city\nJosé;Zürich\nAna;Köln\n", "latin-1")
    os.rename(path, path + ".csv")
    df = readers.load_dataset(spark, path + ".csv")
    assert sorted(r["city"] for r in df.collect()) == ["Köln", "Zürich"]


def test_single_column_csv(spark):
    path = _write(spark, "one", "x\n1\n2\n3\n")
    os.rename(path, path + ".csv")
    df = readers.load_dataset(spark, path + ".csv")
    assert df.columns == ["x"] and df.count() == 3


def test_tsv_and_json_variants(spark):
    p = _write(spark, "t", F1_CSV.replace(",", "\t"))
    os.rename(p, p + ".tsv")
    assert readers.load_dataset(spark, p + ".tsv").count() == 5
    arr = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    p = _write(spark, "arr", json.dumps(arr, indent=2))
    os.rename(p, p + ".json")
    assert readers.load_dataset(spark, p + ".json").count() == 2
    p = _write(spark, "lines", "\n".join(json.dumps(r) for r in arr))
    os.rename(p, p + ".json")
    assert sorted(r["a"] for r in readers.load_dataset(spark, p + ".json").collect()) == [1, 2]


def test_arff_file(spark):
    text = ("% comment\n@relation r\n@attribute 'id' numeric\n@attribute name string\n"
            "@attribute cls {A,B}\n@data\n1,'x y',A\n2,?,B\n")
    p = _write(spark, "a", text)
    os.rename(p, p + ".arff")
    rows = sorted(readers.load_dataset(spark, p + ".arff").collect())
    assert [tuple(r) for r in rows] == [(1.0, "x y", "A"), (2.0, None, "B")]


def test_roundtrip_parquet_xlsx_arff(spark, f1):
    p = scratch_path(spark, "f1") + ".parquet"
    writers.write_table(f1, p)
    assert readers.load_dataset(spark, p).count() == 15
    x = scratch_path(spark, "wb") + ".xlsx"
    writers.write_xlsx_dir(f1, x, workbooks=2)
    assert len([n for n in os.listdir(x) if n.endswith(".xlsx")]) == 2
    back = readers.load_dataset(spark, x)
    assert back.count() == 15 and dict(back.dtypes)["income"] == "double" and dict(back.dtypes)["target"] == "string"
    a = scratch_path(spark, "f1") + ".arff"
    writers.write_arff(f1, a)
    assert sorted(r["age"] for r in readers.load_dataset(spark, a).collect())[:2] == [22.0, 24.0]


def test_unsupported_format(spark):
    with pytest.raises(ValueError, match="Supported formats"):
        readers.load_dataset(spark, "/tmp/whatever.xls")


def _named(spark, name, data, suffix):
    path = scratch_path(spark, name) + suffix
    with open(path, "wb") as fh:
        fh.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_csv_quotes_line_breaks_and_missing_cells(spark):
    p = _named(spark, "q", 'a,b,c\n1,"he said ""hi"", ok",NA\n2,"two\nlines",3.5\n', ".csv")
    rows = {r.a: r for r in readers.load_dataset(spark, p).collect()}
    assert rows[1].b == 'he said "hi", ok' and rows[2].b == "two\nlines"
    assert rows[1].c is None and rows[2].c == 3.5


def test_csv_late_bytes_and_cp1252(spark):
    p = _named(spark, "late", ("a,b\n" + "1,x\n" * 500 + "2,Zürich\n").encode("latin-1"), ".csv")
    assert readers.load_dataset(spark, p).where("a = 2").first().b == "Zürich"
    p = _named(spark, "cp", "a,b\n1,€ “x”\n".encode("cp1252"), ".csv")
    assert readers.read_csv(spark, p, encoding="cp1252").first().b == "€ “x”"


def test_arff_data_that_starts_with_at(spark):
    p = _named(spark, "at", "@relation r\n@attribute u string\n@attribute n numeric\n@data\n@bob,1\n@data2,2\n", ".arff")
    assert sorted(tuple(r) for r in readers.load_dataset(spark, p).collect()) == [("@bob", 1.0), ("@data2", 2.0)]


@pytest.mark.parametrize("text", ['{\n "a": 1,\n "b": "x"\n}', '{"a": [1], "b": ["x"]}', '{"a": {"0": 1}, "b": {"0": "x"}}', '[{"a": 1,\n"b": "x"}]',
                                  '{"a": 1, "b": "x"}\n'])
def test_json_forms(spark, text):
    rows = readers.load_dataset(spark, _named(spark, "doc", text, ".json")).collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x")]


def test_workbooks_with_columns_in_another_order(spark):
    from tablelens.sources.writers import _xlsx_bytes
    d = scratch_path(spark, "books") + ".xlsx"
    os.makedirs(d)
    for k, (names, row) in enumerate([(["a", "b"], [1, "x"]), (["b", "a"], ["y", 2])]):
        with open(f"{d}/w{k}.xlsx", "wb") as fh:
            fh.write(_xlsx_bytes(names, [row]))
    assert sorted((r.a, r.b) for r in readers.load_dataset(spark, d).collect()) == [(1.0, "x"), (2.0, "y")]


def test_filters_and_columns_reach_the_scan(spark):
    df = readers.load_dataset(spark, "/root/testdata/sf0.001/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def _folder(spark, name, texts):
    d = scratch_path(spark, name) + ".json"
    os.makedirs(d)
    for k, text in enumerate(texts):
        with open(f"{d}/f{k}.json", "w") as fh:
            fh.write(text)
    return d


@pytest.mark.parametrize("indent", [1, None])
def test_several_documents_by_column(spark, indent):
    docs = [{"a": [1, 2], "b": ["x", "y"]}, {"a": [3, 4, 5], "b": ["z", None, "w"]}, {"a": [6]}, {"a": [], "b": []}]
    got = readers.load_dataset(spark, _folder(spark, "columns", [json.dumps(x, indent=indent) for x in docs]))
    assert sorted((r.a, r.b) for r in got.collect() if r.b) == [(1, "x"), (2, "y"), (3, "z"), (5, "w")]
    assert sorted(r.a for r in got.collect() if r.b is None) == [4, 6]


def test_several_pretty_printed_documents_by_column_and_key(spark):
    docs = [{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}, {"a": {"0": 3}, "b": {"0": "z"}}]
    got = readers.load_dataset(spark, _folder(spark, "keyed", [json.dumps(x, indent=1) for x in docs]))
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_records_that_have_arrays_stay_records(spark):
    one, two = {"a": [1, 2], "b": [3]}, {"a": [4], "b": [5]}
    for texts in ([json.dumps([one, two], indent=1)], [json.dumps([x], indent=1) for x in (one, two)], [json.dumps(one) + "\n" + json.dumps(two)]):
        assert sorted(r.a for r in readers.load_dataset(spark, _folder(spark, "records", texts)).collect()) == [[1, 2], [4]]


@pytest.mark.parametrize("key", ["load_json_columns", "load_json_object"])
def test_documents_grow_in_number_with_the_rows(spark, monkeypatch, key):
    from tablelens.plans import queries_sources as Q
    from tablelens.plans.catalog import QUERIES
    monkeypatch.setattr(Q, "DOCUMENT_ROWS", 3)
    read, paths = readers.load_dataset, []
    monkeypatch.setattr(readers, "load_dataset", lambda s, p: paths.append(p) or read(s, p))
    rows = QUERIES[key][0](spark, "/root/testdata/sf0.001")
    src = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select(*rows.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, src.collect()))
    assert len([n for n in os.listdir(paths[0].removeprefix("file://")) if n.startswith("part-")]) == -(-src.count() // 3)


def test_workbooks_grow_in_number_with_the_rows(spark, monkeypatch):
    from tablelens.plans.catalog import QUERIES
    monkeypatch.setattr(writers, "WORKBOOK_ROWS", 3)
    read, paths = readers.load_dataset, []
    monkeypatch.setattr(readers, "load_dataset", lambda s, p: paths.append(p) or read(s, p))
    rows = QUERIES["load_xlsx_dir"][0](spark, "/root/testdata/sf0.001")
    src = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, src.collect()))
    assert len([n for n in os.listdir(paths[0].removeprefix("file://")) if n.endswith(".xlsx")]) == -(-src.count() // 3)


def test_workbooks_go_to_a_path_that_is_a_uri(spark, f1):
    path = "file://" + scratch_path(spark, "uri") + ".xlsx"
    writers.write_xlsx_dir(f1, path)
    assert readers.load_dataset(spark, path).count() == 15
