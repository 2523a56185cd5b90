"""Workbooks of several sheets as sources: types, unreadable cells, columns in use, files as other programs write them."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import as_dicts
from panelmill import schema
from panelmill.sources import files, workbooks

KIND = T.StructType([T.StructField("d", T.DateType()), T.StructField("t", T.StringType()), T.StructField("v", T.DoubleType())])
DAY = dt.date(2020, 2, 29)


def rows_of(content, kind=KIND):
    return list(workbooks.sheet_rows(content, kind))


def test_round_trip_of_cells():
    rows = [(DAY, 'a <&> "ş" ', 0.1), (None, None, None), (None, "", -1e-300), (dt.date(1900, 3, 1), "12", 3)]
    book = workbooks.workbook({"A & B": (["d", "t", "v"], rows), "two": (["v"], [(7.5,)]), "none": (["d"], [])})
    assert rows_of(book) == [("A & B", [DAY, 'a <&> "ş" ', 0.1], 0), ("A & B", [None, None, -1e-300], 0),
                             ("A & B", [dt.date(1900, 3, 1), "12", 3.0], 0), ("two", [None, None, 7.5], 0)]


def test_files_of_other_programs():
    """Shared strings with runs, cell references with gaps, the 1904 calendar, errors, text in number columns."""
    sheet = ('<worksheet xmlns="{m}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="AA1" t="s"><v>1</v></c><c r="AB1" t="str"><v>t</v></c></row>'
             '<row r="2"><c r="B2"><v>1</v></c><c r="AA2"><v>2.5E0</v></c><c r="AB2" t="s"><v>2</v></c></row>'
             '<row r="3"><c r="AA3" t="e"><v>#DIV/0!</v></c><c r="AB3"><v>5</v></c></row>'
             '<row r="4"><c r="B4" t="str"><v>soon</v></c><c r="AA4" t="s"><v>2</v></c></row>'
             '<row r="5"><c r="B5" t="d"><v>2020-02-29T00:00:00</v></c><c r="C5"><v>1</v></c></row></sheetData></worksheet>')
    m = workbooks.MAIN.strip("{}")
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{workbooks.RELATION.strip("{}")}"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{workbooks.PACKAGE.strip("{}")}"><Relationship Id="x" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>d</t></si><si><t> v</t></si><si><r><t>ab</t></r><r><t>c</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/a.xml": sheet.replace("{m}", m)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, body in parts.items():
            book.writestr(name, body)
    assert rows_of(out.getvalue()) == [
        ("S", [dt.date(1904, 1, 2), "abc", 2.5], 0), ("S", [None, "5", None], 1), ("S", [None, None, None], 2), ("S", [DAY, None, None], 0)]


def test_workbooks_read_as_the_sheets_do(spark, frame, tmp_path):
    """The same rows as CSV sheets and as workbook files give the same panel; bad cells are counted per sheet."""
    heads = list(schema.PRICE_NAMES)
    price = [(dt.date(2020, 1, d), f"C{d % 3}", f"Fon İ{d}", d / 7, 1.0 * d, 2.0, None if d == 4 else d * 1e6) for d in range(1, 9)]
    for name, types in {"one": {"A": price[:3], "B": price[3:5]}, "two": {"A": price[5:]}}.items():
        (tmp_path / f"{name}.xlsx").write_bytes(workbooks.workbook({k: (heads, v) for k, v in types.items()}))
    (tmp_path / "notes.txt").write_text("no workbook")
    got = workbooks.read_price_workbooks(workbooks.workbook_files(spark, str(tmp_path)))
    for kind, part in {"A": price[:3] + price[5:], "B": price[3:5]}.items():
        spark.createDataFrame(part, schema.PRICE_SHEET).write.option("header", True).csv(str(tmp_path / f"csv-{kind}"))
    sheets = files.read_prices(spark, {k: str(tmp_path / f"csv-{k}") for k in "AB"})
    assert sorted(map(str, got.select(*sheets.columns).collect())) == sorted(map(str, sheets.collect()))
    assert workbooks.bad_cells(got.withColumnRenamed("fund_type", "sheet")).collect() == []
    broken = workbooks.workbook({"A": (heads, [(DAY, "C", "n", "x", "y", 1.0, 1.0), (DAY, "C", "n", "z", 1.0, 1.0, 1.0)])})
    table = spark.createDataFrame([("p", broken), ("q", None)], "path string, content binary")
    assert as_dicts(workbooks.bad_cells(workbooks.read_workbooks(table, schema.PRICE_SHEET))) == [{"path": "p", "sheet": "A", "rows": 2, "cells": 3}]


def test_only_declared_columns_and_whole_batches(spark):
    """More rows than one batch of output; the columns that aren't declared stay in the file."""
    n = workbooks.ROWS_A_BATCH * 2 + 5
    content = workbooks.workbook({"S": (["v", "junk"], [(float(i), "j") for i in range(n)])})
    table = spark.createDataFrame([("p", bytearray(content))], "path string, content binary")
    out = workbooks.read_workbooks(table, T.StructType([KIND["v"]]))
    assert out.columns == ["path", "sheet", "v", workbooks.BAD_CELLS]
    assert out.agg(F.count("v"), F.sum("v")).first() == (n, n * (n - 1) / 2)


def test_written_batches(spark, frame):
    df = frame([("A", "2020-01-01", "x", 1.5), ("B", None, None, None), (None, "2020-01-02", "y", 2.0)], "s string, d date, t string, v double")
    books = workbooks.to_workbooks(df.coalesce(1), "s")
    assert books.count() == 1
    rows = as_dicts(workbooks.read_workbooks(books, KIND).drop("path"))
    assert [(r["sheet"], r["d"], r["t"], r["v"], r["_bad_cells"]) for r in rows] == [
        ("A", dt.date(2020, 1, 1), "x", 1.5, 0), ("", dt.date(2020, 1, 2), "y", 2.0, 0)]
    assert workbooks.read_workbooks(workbooks.to_workbooks(df.limit(0), "s"), KIND).collect() == []


def test_no_workbook_is_an_error(spark):
    table = spark.createDataFrame([("p", bytearray(b"text"))], "path string, content binary")
    with pytest.raises(PythonException):
        workbooks.read_workbooks(table, KIND).collect()


def sheet_of(body):
    """A workbook whose one sheet has the given rows, as text."""
    book = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbooks.workbook({"S": ([], [])}))) as old, zipfile.ZipFile(book, "w") as new:
        for part in old.namelist():
            new.writestr(part, old.read(part) if "sheet1" not in part else f'<worksheet xmlns="{workbooks.MAIN.strip("{}")}"><sheetData>{body}</sheetData></worksheet>')
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN.strip("{}")}"><si><t>d</t></si><si><t/></si><si><t>7</t></si></sst>')
    return book.getvalue()


HEADINGS = '<row r="1"><c t="s"><v>0</v></c><c t="inlineStr"><is><t>t</t></is></c><c r="D1" t="str"><v>v</v></c></row>'


def test_plain_sheets_are_read_and_written_by_columns(spark, frame, monkeypatch):
    """No row of a plain sheet goes through the XML parser, and no cell of a plain column is written by itself."""
    df = frame([("A", f"2020-01-{1 + i % 28:02d}", f"<{i}>&", i / 7) for i in range(500)], "s string, d date, t string, v double")
    written = []
    monkeypatch.setattr(workbooks, "_cell", lambda value, cell=workbooks._cell: written.append(value) or cell(value))
    batch = pa.table({"d": [DAY, None], "t": ["<a>&b", None], "v": [0.1, None], "n": [7, None]}).to_batches()[0]
    cells = [workbooks._cells_of(c).to_pylist() for c in batch.columns]
    assert written == []
    assert cells == [[workbooks._cell(v) for v in c.to_pylist()] for c in batch.columns]
    (book,) = workbooks.to_workbooks(df.coalesce(1), "s").collect()
    monkeypatch.setattr(workbooks, "_rows", None)
    rows = rows_of(book.content)
    assert [(t, v) for _, (_, t, v), _ in rows] == [(f"<{i}>&", i / 7) for i in range(500)]


@pytest.mark.parametrize("body", [
    '<row><c/><c><v>12</v></c><c/><c><v>1e400</v></c></row><row/><row></row><row><c r="D4"><v>-1.5E-3</v></c><c><v>9</v></c></row>',
    '<row r="2" spans="1:4"><c r="A2" s="1"><v>43890.7</v></c><c r="D2" t="e"><v>#N/A</v></c></row>\n <row><c t="e"><v>#N/A</v></c></row>',
    '<row><c><v>9999999</v></c><c t="s"><v>1</v></c><c/><c t="s"><v>2</v></c></row><row><c t="str"><v/></c><c t="inlineStr"><v>no</v></c></row>',
    '<row><c t="str"><v> 2020-02-29T00:00</v></c><c t="inlineStr"><is><t xml:space="preserve"> &lt;&amp;lt;&quot; ş </t></is></c></row>',
    '<row><c r="B9"><v>1</v></c><c r="B9"><v>2</v></c><c r="B9"><v/></c><c/><c t="str"><v> 1_0 </v></c></row><row><c/><c/><c/><c><v>nan</v></c></row>',
    '<row><c><v>1</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
    '<row><c><v>1</v></c></row><!-- <row><c><v>2</v></c></row> --><row><c><f>A1</f><v>3</v></c><c t="str"><v>&#65;</v></c></row>',
    "<row><c><v>1</v></c></row ><row><c t='str'><v>2020-01-01</v></c><c><v><![CDATA[</row>]]></v></c></row>",
    '<row><c t="b"><v>1</v></c><c t="b"><v>1</v></c><c/><c t="b"><v>1</v></c></row><row><c><v>-1000000</v></c></row><row><c/><c><is><t>x</t></is></c></row>',
])
@pytest.mark.parametrize("bytes_a_piece", [16, 4 << 20])
def test_both_ways_of_reading_agree(monkeypatch, body, bytes_a_piece):
    book = sheet_of(HEADINGS + body)
    monkeypatch.setattr(workbooks, "BYTES_A_PIECE", max(bytes_a_piece, 150))
    by_columns = rows_of(book)
    monkeypatch.setattr(workbooks, "_plain_rows", lambda *_: iter([None]))
    assert str(by_columns) == str(rows_of(book)) and by_columns


@pytest.mark.parametrize("body", ["<row><c><v>1</v></row>", "<row><c><v>1</c></v></row>", '<row><c t="s"><v>9</v></c></row>', '<row><c t="s"><v/></c></row>', "<row><c><v>\x01</v></c></row>", "<row><c><v>&no;</v></c></row>"])
def test_broken_sheets_are_errors_both_ways(monkeypatch, body):
    book = sheet_of(HEADINGS + body)
    for plain in (workbooks._plain_rows, lambda *_: iter([None])):
        monkeypatch.setattr(workbooks, "_plain_rows", plain)
        with pytest.raises((SyntaxError, IndexError, ValueError)):
            rows_of(book)
