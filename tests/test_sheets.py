import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mensura.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheet, shared=None, names=("Notes", "Data")):
    """A package as spreadsheet programs write it: shared strings, several sheets, targets by relation."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{sheets.OFFICE}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sheets.PACKAGE}"><Relationship Id="r1" Target="/xl/worksheets/b.xml"/>'
                   '<Relationship Id="r0" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")


SHARED = ("<si><t>id</t></si><si><t>age</t></si><si><r><t>gro</t></r><r><t>up</t></r><rPh sb='0' eb='1'><t>hint</t></rPh></si><si><t>seen</t></si>"
          "<si><t>ok</t></si><si><t xml:space='preserve'> a &amp; b</t></si><si><t/></si>")
ROWS = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="C1" t="s"><v>1</v></c><c r="AA1" t="s"><v>3</v></c><c r="AB1" t="s"><v>4</v></c></row>'
        '<row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>5</v></c><c r="C2"><v>9.5</v></c><c r="AA2"><v>45000</v></c><c r="AB2" t="b"><v>1</v></c></row>'
        '<row r="3"/><row r="4"><c r="B4" t="s"><v>6</v></c></row>'
        '<row r="5"><c r="A5"><v>8.0</v></c><c r="B5" t="inlineStr"><is><t>x</t></is></c><c r="C5" t="e"><v>#N/A</v></c><c r="AA5" t="str"><v>2024-02-03</v></c><c r="AB5" t="b"><v>0</v></c></row>'
        '<row r="6"><c r="A6"><v>1E3</v></c><c r="C6" t="str"><f>A6</f><v>2</v></c></row>')
SCHEMA = "id bigint, age double, group string, seen date, ok boolean"


def test_typed_cells(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS, SHARED)
    rows = sheets.read_sheet(spark, str(tmp_path), SCHEMA, "Data").orderBy("id").collect()
    day = datetime.date
    assert [tuple(r) for r in rows] == [
        (7, 9.5, " a & b", day(2023, 3, 15), True), (8, None, "x", day(2024, 2, 3), False), (1000, 2.0, None, None, None)]
    assert sheets.read_sheet(spark, str(tmp_path), SCHEMA, 1).count() == 3


def test_wrong_sheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS, SHARED)
    for schema, sheet, message in (
        ("id int, height int", 1, "lacks the columns .'height'."), ("id int", "Other", "no sheet 'Other'"), ("id int", 0, "lacks the columns"),
        ("group int", 1, "a cell of group is no int"), ("id int, seen int", 1, "a cell of seen is no int"),
    ):
        with pytest.raises(Exception, match=message):
            sheets.read_sheet(spark, str(tmp_path), schema, sheet).collect()


def test_rows_are_streamed(monkeypatch):
    """Rows come before the sheet has been read to its end."""
    buffer = io.BytesIO()
    workbook(buffer, "".join(f'<row><c t="inlineStr"><is><t>{"x" * 50}{i}</t></is></c></row>' for i in range(30_000)))
    read, original = [0], zipfile.ZipExtFile.read

    def counting(self, n=-1):
        data = original(self, n)
        read[0] += len(data)
        return data

    monkeypatch.setattr(zipfile.ZipExtFile, "read", counting)
    found = sheets.rows(buffer, "Data")
    assert next(found)[0].endswith("x0") and read[0] < 200_000
    assert sum(1 for _ in found) == 29_999


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("p", 1, 2.5, "a<b>&\"c\"", True), ("p", 2, None, " é\n", False), ("q", -3, 1e-30, None, None)], "book string, n bigint, x double, s string, b boolean")
    sheets.write_sheets(df, "book", str(tmp_path / "new"))
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["p.xlsx", "q.xlsx"]
    back = sheets.read_sheet(spark, str(tmp_path / "new"), "s string, n bigint, b boolean, x double")
    assert sorted(map(tuple, back.select("n", "x", "s", "b").collect())) == sorted(tuple(r)[1:] for r in df.collect())
    assert sheets.read_sheet(spark, str(tmp_path / "new" / "q.xlsx"), "n int").collect()[0].n == -3
