import io
import zipfile

import pytest

from panelwright.sources import tables, workbook

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Total</t></is></c></row>
<row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>"""


def book(active=1):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="Cover" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>LGU</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s2.xml", SHEET)
    return b.getvalue()


def test_workbook_expands_merges(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book())
    df = tables.load(spark, str(tmp_path / "a.xlsx"))
    rows = {r["row_idx"]: r["cells"] for r in df.collect()}
    assert rows == {0: ["LGU", "LGU", "Total"], 1: ["1.5", "TRUE", None]}
    assert workbook.preferred_sheet(df, "lgu").first()["sheet"] == "Data" == tables.largest_sheet(df).first()["sheet"]
    assert workbook.cell_position("AB12") == (11, 27)


def test_csv_encodings_and_header_rows(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿Title,,\nGeolocation,2019 Ave,2020 Ave\n\"Ñ, x\",1,2\n".encode())
    (tmp_path / "w.csv").write_bytes("Pe\xf1a,1\n".encode("cp1252"))
    lines = tables.read_csv_lines(spark, str(tmp_path / "*.csv"))
    got = {(r["file_name"], r["row_idx"]): r["cells"] for r in lines.collect()}
    assert got["u.csv", 0][0] == "Title" and got["u.csv", 2] == ["Ñ, x", "1", "2"] and got["w.csv", 0] == ["Peña", "1"]
    assert tables.header_row(lines, "geolocation").first()["header_row"] == 1
    pruned = tables.read_csv(spark, str(tmp_path / "u.csv"), columns=lambda c: c.endswith("Ave"), skip=1)
    assert pruned.columns == ["2019 Ave", "2020 Ave"] and pruned.first()["2020 Ave"] == "2"


def test_directory_isolates_errors(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book())
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    (tmp_path / "c.xls").write_bytes(b"old")
    df, errors = tables.load_directory(spark, str(tmp_path / "*.xls*"))
    assert df.count() == 2 and set(errors) == {"b.xlsx", "c.xls"}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, level string")
    tables.write_parquet(df, str(tmp_path / "p"), ["level"])
    assert tables.read_parquet(spark, str(tmp_path / "p")).filter("level = 'a'").first()["id"] == 1
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    tables.write_text(df.orderBy("id"), str(tmp_path / "t.txt"), "Report")
    assert (tmp_path / "t.txt").read_text().splitlines()[2:] == ["id | level", "1 | a", "2 | b"]
    df.write.parquet(str(tmp_path / "x.parquet"))
    assert tables.convert_folder(spark, str(tmp_path)) == ["x.parquet"]
    with pytest.raises(ValueError):
        tables.load(spark, "a.doc")
