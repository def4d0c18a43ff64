"""Workbooks made by hand: shared, rich and inline strings, numbers, gaps; uploads and exports."""

import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import sinks
from siltstone.sources import workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHARED = f'<sst xmlns="{MAIN}"><si><t> Property  ID</t></si><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si><si><t>Opened</t></si><si><t>Älpha &amp; Co</t></si></sst>'
HEADER = '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="AB3" t="s"><v>2</v></c><c r="AC3" t="inlineStr"><is><t>NAME</t></is></c></row>'


def write_workbook(path, rows, sheet="DataStorage"):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name="Other" r:id="a"/><sheet name="{sheet}" r:id="b"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", SHARED)
        book.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="str"><v>title</v></c></row>{HEADER}{rows}</sheetData></worksheet>')


def cells(number, key, name, day="", other=""):
    parts = [f'<c r="A{number}"><v>{key}</v></c>' if key else f'<c r="A{number}"/>', f'<c r="C{number}" {name}</c>', f'<c r="AB{number}"><v>{day}</v></c>' if day else "", f'<c r="AC{number}" t="str"><v>{other}</v></c>' if other else ""]
    return f'<row r="{number}">{"".join(parts)}</row>'


HEADERS = {"property id": "id", "Name": "name", "opened": "opened", "Absent": "absent"}


def test_sheets_of_several_files(spark, tmp_path):
    write_workbook(tmp_path / "1.xlsx", cells(4, "7", 't="s"><v>3</v>', "45000.5", "later") + '<row r="5"/>' + cells(6, "", 't="inlineStr"><is><t>no key</t></is>'))
    write_workbook(tmp_path / "2.xlsx", "".join(cells(4 + i, str(7 + i), f't="str"><v>n{i}</v>') for i in range(2500)))
    rows = workbooks.sheet_rows(spark, [str(tmp_path / "1.xlsx"), str(tmp_path / "2.xlsx")], HEADERS, "DataStorage", 3)
    got = sorted((r.path[-6:], r.row, r.id, r.name, r.opened, str(r.day), r.absent) for r in rows.withColumn("day", workbooks.serial_date(F.col("opened"))).collect() if r.row < 7)
    assert got[:2] == [("1.xlsx", 4, "7", "Älpha & Co", "45000.5", "2023-03-15", None), ("1.xlsx", 6, None, "no key", None, "None", None)]
    once = sinks.first_seen(rows, "id", "path", "row")
    assert once.count() == 2500 and once.filter("id = '7'").first().name == "Älpha & Co"


def test_missing_sheet(spark, tmp_path):
    write_workbook(tmp_path / "1.xlsx", "")
    assert workbooks.sheet_rows(spark, str(tmp_path / "1.xlsx"), HEADERS, "DataStorage", 3).collect() == []
    assert workbooks.sheet_rows(spark, str(tmp_path / "1.xlsx"), HEADERS).collect() == []
    with pytest.raises(Exception, match="no sheet 'Absent'"):
        workbooks.sheet_rows(spark, str(tmp_path / "1.xlsx"), HEADERS, "Absent", 3).collect()


def test_uploads(spark, tmp_path):
    write_workbook(tmp_path / "u.xlsx", cells(4, "1", 't="s"><v>3</v>') + cells(5, "2", 't="str"><v>two</v>') + cells(6, "", 't="str"><v>none</v>') + cells(7, "2", 't="str"><v>two</v>'))
    (tmp_path / "u.csv").write_text('Property ID, NAME\n2,two\n3,"three, with\na break"\n')
    folder = str(tmp_path / "ledger")
    headers = {"Property ID": "id", "Name": "name"}
    runs = []
    for batch, name in enumerate(("u.xlsx", "u.xlsx", "u.csv", "u.csv")):
        rows = workbooks.upload_rows(spark, str(tmp_path / name), headers, "DataStorage", 3)
        runs.append(sinks.load_upload(rows, "id", folder, min(batch, 2), name))  # the last one is given twice
    assert [(r.source, r.read, r.written, r.skipped) for r in runs] == [("u.xlsx", 4, 2, 2), ("u.xlsx", 4, 0, 4), ("u.csv", 2, 1, 1), ("u.csv", 2, 1, 1)]
    assert sorted((r.id, r.name) for r in spark.read.parquet(f"{folder}/rows").collect()) == [("1", "Älpha & Co"), ("2", "two"), ("3", "three, with\na break")]
    with pytest.raises(ValueError, match="csv or xlsx"):
        workbooks.upload_rows(spark, str(tmp_path / "u.txt"), headers)


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', [1, 2]), (2, None, None)], "id int, `t.x` string, l array<int>")
    sinks.export_csv(rows, str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert got.columns == ["id", "t.x", "l"]
    assert sorted(map(tuple, got.collect())) == [("1", 'a "b", c', "[1,2]"), ("2", None, None)]


def test_route(spark):
    rows = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (1, "b", "x"), (1, "a", "gone"), (1, "a", None)], "k int, c string, s string")
    got = rows.select(sinks.route(F.col("k"), F.col("c"), F.col("s"), ["a"], ["gone"]).alias("r")).collect()
    assert [r.r for r in got] == ["blank", "other_city", "other_city", "dismissed", "project"]
