"""Spreadsheet workbooks (the public Office Open XML layout): a streaming reader and a sink.

A workbook is one task: the format limits a sheet to 1,048,576 rows.  The parts
are read from the package one XML element at a time, so only the shared strings
and the current rows are in memory.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mensura.sources.storage import listed, new_file, open_input

#: Names of the layout.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: rows that leave a task together
BATCH_ROWS = 4096


def _elements(package: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part as they close; what has been seen is dropped."""
    with package.open(part) as stream:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                above[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """Text of a string item: its runs joined, phonetic hints left out."""
    runs = [element.find(f"{MAIN}t"), *[r.find(f"{MAIN}t") for r in element.findall(f"{MAIN}r")]]
    return "".join(r.text or "" for r in runs if r is not None)


def _column(reference: str) -> int:
    """0-based column of a cell reference."""
    at = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def sheet_part(package: zipfile.ZipFile, sheet: str | int) -> str:
    """Name of the part that holds a sheet, by its name or place."""
    book = ElementTree.fromstring(package.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(f"{{{OFFICE}}}id")) for s in book.iter(f"{MAIN}sheet")]
    chosen = [i for place, (name, i) in enumerate(sheets) if sheet in (name, place)]
    if not chosen:
        raise ValueError(f"no sheet {sheet!r} among {[name for name, _ in sheets]}")
    targets = ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))
    target = next(t.get("Target") for t in targets.iter(f"{{{PACKAGE}}}Relationship") if t.get("Id") == chosen[0])
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows(file, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Cells of a sheet's rows as text; empty cells and errors are None, booleans TRUE or FALSE."""
    with zipfile.ZipFile(file) as package:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in package.namelist():
            shared = [_text(item) for item in _elements(package, "xl/sharedStrings.xml", f"{MAIN}si")]
        for row in _elements(package, sheet_part(package, sheet), f"{MAIN}row"):
            cells: list[str | None] = []
            for cell in row.findall(f"{MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    cells[at] = _text(cell.find(f"{MAIN}is"))
                elif value is None or value.text is None or kind == "e":
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(value.text)]
                elif kind == "b":
                    cells[at] = "TRUE" if value.text == "1" else "FALSE"
                else:
                    cells[at] = value.text
            yield [c or None for c in cells]


def _typed(cell: Column, kind: T.DataType) -> Column:
    """Whole numbers may be written as 3.0 or 3E0 and dates as days since the end of 1899."""
    if isinstance(kind, T.StringType):
        return cell
    if isinstance(kind, T.DateType):
        return F.coalesce(F.date_add(F.lit("1899-12-30").cast("date"), cell.try_cast("double").cast("int")), cell.try_cast("date"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(cell.try_cast(kind), F.when(cell.try_cast("double") % 1 == 0, cell.try_cast("double").try_cast(kind)))
    return cell.try_cast(kind)


def read_sheet(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, sheet: str | int = 0) -> DataFrame:
    """Rows below the header of a sheet, columns by name; other columns are left out.

    A declared column that is missing is an error, and so is a cell that is not
    of its column's type.  Empty cells are null and rows without a cell are skipped.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as file:
                    found = rows(file, sheet)
                    header = next(found, [])
                    lacking = sorted(set(names) - set(header))
                    if lacking:
                        raise ValueError(f"the sheet of {path} lacks the columns {lacking}")
                    places, held = [header.index(n) for n in names], []
                    for row in found:
                        if any(c is not None for c in row):
                            held.append([row[p] if p < len(row) else None for p in places])
                        if len(held) == BATCH_ROWS:
                            yield _batch(held, names)
                            held = []
                    yield _batch(held, names)

    texts = listed(spark, paths).select("path").repartition("path").mapInArrow(read, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    checked = []
    for f in fields:
        cell, value = F.col(f"`{f.name}`"), _typed(F.col(f"`{f.name}`"), f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"a cell of {f.name} is no {f.dataType.simpleString()}: "), cell))
        checked.append(F.when(cell.isNull() | value.isNotNull(), value).otherwise(wrong.cast(f.dataType)).alias(f.name))
    return texts.select(*checked)


def _batch(held: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(len(names))], names=names)


_TYPES = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
          '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
          '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')


def _relations(kind: str, target: str) -> str:
    return f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/{kind}" Target="{target}"/></Relationships>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_sheets(df: DataFrame, file: str, folder: str, sheet: str = "Sheet1") -> None:
    """One workbook per value of the column ``file``, with the other columns below a header, streamed row by row."""
    columns = [c for c in df.columns if c != file]
    ordered = df.select(F.col(file).cast("string").alias("_file"), *columns).repartition("_file").sortWithinPartitions("_file", *columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, closing = [], None

        def begin(name: str):
            context = new_file(f"{folder}/{name}.xlsx")
            package = zipfile.ZipFile(context.__enter__(), "w", zipfile.ZIP_DEFLATED)
            package.writestr("[Content_Types].xml", _TYPES)
            package.writestr("_rels/.rels", _relations("officeDocument", "xl/workbook.xml"))
            package.writestr("xl/_rels/workbook.xml.rels", _relations("worksheet", "worksheets/sheet1.xml"))
            package.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            part = package.open("xl/worksheets/sheet1.xml", "w")
            put = lambda cells: part.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())
            part.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            put(columns)

            def end():
                part.write(b"</sheetData></worksheet>")
                part.close()
                package.close()
                context.__exit__(None, None, None)

            return put, end

        put = None
        for batch in batches:
            for name, *cells in zip(*[c.to_pylist() for c in batch.columns]):
                if not made or made[-1] != name:
                    if closing:
                        closing()
                    put, closing = begin(name)
                    made.append(name)
                put(cells)
        if closing:
            closing()
        yield pa.RecordBatch.from_pydict({"file": pa.array(made, pa.string())})

    ordered.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
