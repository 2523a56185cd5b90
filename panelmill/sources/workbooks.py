"""Spreadsheet workbooks (Office Open XML) as typed rows: every sheet of many files, one task per share of the files.

Files come as Spark's ``binaryFile`` rows (path, content), from any file system that Spark reads, or from any table with
these two columns. A file is read in one task, its sheets by pieces of whole rows, so a task holds one file and one piece.
Pieces in which every tag is a row, a cell or its value are read by columns; a sheet with anything else (formulas, rich
texts, comments) row by row with an XML parser from there on. Both give the same rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill import schema

BAD_CELLS = "_bad_cells"
# Namespaces and first days of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
FIRST_DAY, FIRST_DAY_1904 = dt.date(1899, 12, 30), dt.date(1904, 1, 1)
EPOCH = dt.date(1970, 1, 1)
ROWS_A_BATCH = 10_000
BYTES_A_PIECE = 4 << 20
ARROW_TYPES = {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.DateType: pa.date32(), T.IntegerType: pa.int32()}

# Tags of plain rows, and which may follow which. A cell holds a value or an inline text, each at most once.
TAGS = ("row", "row/", "/row", "c", "c/", "/c", "v", "v/", "/v", "is", "/is", "t", "t/", "/t")
FOLLOWS = {
    "row": "c c/ /row", "row/": "row row/", "/row": "row row/", "c": "v v/ is /c", "c/": "c c/ /row", "/c": "c c/ /row",
    "v": "/v", "v/": "/c", "/v": "/c", "is": "t t/", "/is": "/c", "t": "/t", "t/": "/is", "/t": "/is",
}
CODES = {tag: i for i, tag in enumerate(TAGS)}
ALLOWED = np.array([[after in FOLLOWS[tag].split() for after in TAGS] for tag in TAGS])
TAG = re.compile(r"""<(/?)([a-z]+)((?:\s+[\w:]+="[^"&]*")*)\s*(/?)>""")
ATTRIBUTE = re.compile(r"""([\w:]+)="([^"]*)\"""")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
NO_NUMBER = ~np.isin(np.arange(256), [*b"0123456789+-.eE"])
UNPLACED = -2
KINDS = ("n", "e", "str", "s", "inlineStr")
NUMBER, ERROR, TEXT, SHARED, INLINE = range(5)


def _text(node: ElementTree.Element) -> str:
    """The text of a string's runs, without phonetic hints."""
    direct = [t.text or "" for t in node.findall(f"{MAIN}t")]
    return "".join(direct + [t.text or "" for t in node.findall(f"{MAIN}r/{MAIN}t")])


def _place(reference: str) -> int:
    """Column number of a cell reference such as ``AB12``."""
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _rows(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[dict[int, tuple[str, str | None]]]:
    """Cells of each row: column number to (kind, text). Empty cells are left out."""
    with book.open(part) as stream:
        parents: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if node.tag != f"{MAIN}row":
                continue
            cells, place = {}, -1
            for cell in node.findall(f"{MAIN}c"):
                place = _place(cell.get("r")) if cell.get("r") else place + 1
                kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    inline = cell.find(f"{MAIN}is")
                    kind, value = "str", None if inline is None else _text(inline)
                elif kind == "s" and value is not None:
                    kind, value = "str", strings[int(value)]
                if value:
                    cells[place] = kind, value
            yield cells
            if parents:
                parents[-1].remove(node)


def _value(kind: str, text: str, wanted: T.DataType, first_day: dt.date) -> object:
    """The cell as its declared type; an error if it isn't one."""
    if kind == "e":
        raise ValueError(text)
    if isinstance(wanted, T.DateType):
        if kind == "n":
            return first_day + dt.timedelta(days=int(float(text)))
        return dt.date.fromisoformat(text.strip()[:10])
    if isinstance(wanted, T.DoubleType):
        return float(text)
    return text


class _Cells(NamedTuple):
    """The cells of some rows that hold a text, in order."""

    rows: int
    row: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    text: pa.Array


def _tag(text: str) -> tuple[int, int, int] | None:
    """Code of a plain tag, and a cell's place and kind; kinds that are read as texts count as one."""
    parts = TAG.fullmatch(text)
    code = parts and CODES.get(parts[1] + parts[2] + parts[4])
    if code is None or (parts[1] and parts[3]):
        return None
    given = dict(ATTRIBUTE.findall(parts[3]))
    return code, _place(given["r"]) if given.get("r") else UNPLACED, KINDS.index(t) if (t := given.get("t", "n")) in KINDS else TEXT


def _cells(piece: bytes, strings: pa.Array) -> _Cells | None:
    """The cells of a piece of whole rows; None if it has anything but plain rows."""
    data = np.frombuffer(piece, np.uint8)
    start, end = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    if not len(start) or len(start) != len(end) or (start >= end).any() or (end[:-1] >= start[1:]).any():
        return None
    # characters that XML refuses, ends of line that it changes, other entities
    if np.count_nonzero(data < 32) != piece.count(b"\n") + piece.count(b"\t") or b"\xef\xbf\xbe" in piece or b"\xef\xbf\xbf" in piece:
        return None
    if b"&" in piece and piece.count(b"&") != sum(piece.count(e.encode()) for e in ENTITIES):
        return None
    offsets = np.append(np.stack([start, end + 1], 1).ravel(), len(data)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(piece)])
    try:
        tags = parts.take(pa.array(np.arange(0, len(parts), 2))).cast(pa.string()).dictionary_encode()
    except pa.ArrowInvalid:
        return None
    known = [_tag(t) for t in tags.dictionary.to_pylist()]
    if None in known:
        return None
    which = tags.indices.to_numpy()
    code = np.array([k[0] for k in known])[which]
    ends = [CODES["row"], CODES["row/"]], [CODES["/row"], CODES["row/"]]
    if code[0] not in ends[0] or code[-1] not in ends[1] or not ALLOWED[code[:-1], code[1:]].all():
        return None
    opened = np.isin(code, ends[0])
    at = np.flatnonzero((code == CODES["c"]) | (code == CODES["c/"]))
    row = (np.cumsum(opened) - 1)[at]

    # a cell without a reference stands beside the one before it, the first one of a row in the first column
    given = np.array([k[1] for k in known])[which[at]]
    number = np.arange(len(at))
    fixed = (given != UNPLACED) | (np.diff(row, prepend=-1) != 0)
    since = np.maximum.accumulate(np.where(fixed, number, 0))
    place = np.where(given != UNPLACED, given, 0)[since] + number - since if len(at) else number

    kind = np.array([k[2] for k in known])[which[at]]
    inline = kind == INLINE
    after = np.append(code, [-1, -1])
    if ((kind == SHARED) & (after[at + 1] == CODES["v/"])).any():
        return None
    value = np.where(inline, at + 2, at + 1)
    holds = np.where(inline, (after[at + 1] == CODES["is"]) & (after[at + 2] == CODES["t"]), after[at + 1] == CODES["v"])
    value, row, place, kind = (x[holds] for x in (value, row, place, np.where(inline, TEXT, kind)))
    try:
        text = parts.take(pa.array(2 * value + 1)).cast(pa.string())
        if b"&" in piece:
            for entity, plain in ENTITIES.items():
                text = pc.replace_substring(text, entity, plain)
        shared = kind == SHARED
        if shared.any():
            found = strings.take(text.filter(pa.array(shared)).cast(pa.int64()).cast(pa.uint64()))
            text, kind = pc.replace_with_mask(text, pa.array(shared), found), np.where(shared, TEXT, kind)
    except (pa.ArrowInvalid, pa.ArrowIndexError):
        return None
    full = pc.binary_length(text).to_numpy() > 0
    return _Cells(int(opened.sum()), row[full], place[full], kind[full], text.filter(pa.array(full)))


def _plain_rows(book: zipfile.ZipFile, part: str, strings: pa.Array) -> Iterator[_Cells | None]:
    """The cells of a sheet by pieces of whole rows; None, and nothing more, where it is no longer plain."""
    def rows_outside(sheet: bytes) -> bool:
        root = ElementTree.fromstring(sheet)
        return root.find(f"{MAIN}sheetData") is None or next(root.iter(f"{MAIN}row"), None) is not None

    with book.open(part) as stream:
        before, opening, rest = stream.read(BYTES_A_PIECE).partition(b"<sheetData>")
        encoding = re.search(rb"""<\?xml[^>]*encoding=["']([^"']*)""", before)
        plain = opening and b"<!" not in before and (encoding is None or encoding[1].lower() == b"utf-8")
        try:
            if not plain or rows_outside(before + opening + b"</sheetData></worksheet>"):
                yield None
                return
        except ElementTree.ParseError:
            yield None
            return
        while True:
            piece, closing, after = rest.partition(b"</sheetData>")
            if not closing:
                cut = rest.rfind(b"</row>") + len(b"</row>") if b"</row>" in rest else 0
                piece, rest = rest[:cut], rest[cut:]
            if piece.strip():
                cells = _cells(piece, strings)
                yield cells
                if cells is None:
                    return
            if closing:
                if rows_outside(before + opening + closing + after + stream.read()):
                    yield None
                return
            more = stream.read(BYTES_A_PIECE)
            if not more:
                yield None
                return
            rest += more


def _typed(kinds: np.ndarray, texts: pa.Array, wanted: T.DataType, first_day: dt.date) -> tuple[pa.Array, np.ndarray]:
    """Cells as their declared type, and which aren't of it; plain texts, numbers and days all at once."""
    bad = kinds == ERROR
    if isinstance(wanted, T.StringType) and not bad.any():
        return texts, bad
    joined = texts.buffers()[2]
    number = isinstance(wanted, T.DoubleType) or (isinstance(wanted, T.DateType) and (kinds == NUMBER).all())
    if number and not bad.any() and joined is not None and not NO_NUMBER[np.frombuffer(joined, np.uint8)].any():
        try:
            found = texts.cast(pa.float64())
            if isinstance(wanted, T.DoubleType):
                return found, bad
            days = np.trunc(found.to_numpy())
            if ((days >= (dt.date.min - first_day).days) & (days <= (dt.date.max - first_day).days)).all():
                return pa.array((days + (first_day - EPOCH).days).astype(np.int32)).cast(pa.date32()), bad
        except pa.ArrowInvalid:
            pass
    values: list[object] = []
    for i, (kind, text) in enumerate(zip(kinds, texts.to_pylist())):
        try:
            values.append(_value(KINDS[kind], text, wanted, first_day))
        except (ValueError, OverflowError):
            values.append(None)
            bad[i] = True
    return pa.array(values, ARROW_TYPES[type(wanted)]), bad


def _columns(cells: _Cells, wanted: list[tuple[int | None, T.DataType]], first_day: dt.date, skipped: int) -> list[pa.Array]:
    """Declared columns and unreadable cells of the rows below the skipped ones that have a declared cell."""
    columns, bad = [], np.zeros(cells.rows, np.int32)
    for place, declared in wanted:
        last = np.full(cells.rows, -1)  # a column's last cell in a row is the one that counts
        mine = np.flatnonzero((cells.place == place) & (cells.row >= skipped)) if place is not None else np.empty(0, int)
        last[cells.row[mine]] = mine
        held = np.flatnonzero(last >= 0)
        values, wrong = _typed(cells.kind[last[held]], cells.text.take(pa.array(last[held])), declared, first_day)
        bad[held[wrong]] += 1
        to = np.zeros(cells.rows, int)
        to[held] = np.arange(len(held))
        columns.append(values.take(pa.array(to, mask=last < 0)))
    used = bad > 0
    for column in columns:
        used |= column.is_valid().to_numpy(zero_copy_only=False)
    return [c.filter(pa.array(used)) for c in (*columns, pa.array(bad))]


def _parsed_columns(rows: Iterator[dict[int, tuple[str, str | None]]], wanted: list[tuple[int | None, T.DataType]],
                    first_day: dt.date) -> Iterator[list[pa.Array]]:
    """What ``_columns`` gives, of rows that an XML parser reads one by one."""
    types = [*(ARROW_TYPES[type(declared)] for _, declared in wanted), pa.int32()]
    lines: list[list[object]] = []
    for cells in rows:
        values, bad = [], 0
        for place, declared in wanted:
            cell = cells.get(place)
            try:
                values.append(None if cell is None else _value(*cell, declared, first_day))
            except (ValueError, OverflowError):
                values.append(None)
                bad += 1
        if bad or any(v is not None for v in values):
            lines.append([*values, bad])
        if len(lines) == ROWS_A_BATCH:
            yield [pa.array(c, t) for c, t in zip(zip(*lines), types)]
            lines = []
    if lines:
        yield [pa.array(c, t) for c, t in zip(zip(*lines), types)]


def _placed(headings: dict[int, str], kind: T.StructType) -> list[tuple[int | None, T.DataType]]:
    places = {text.strip(): place for place, text in headings.items()}
    return [(places.get(f.name), f.dataType) for f in kind]


def sheet_columns(content: bytes, kind: T.StructType) -> Iterator[tuple[str, list[pa.Array]]]:
    """(sheet, declared columns and unreadable cells) of the rows below the headings, which are a sheet's first row.

    A declared heading that a sheet lacks is missing in all its rows; rows without any declared cell are left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        shared = pa.array(strings, pa.string())
        main = ElementTree.fromstring(book.read("xl/workbook.xml"))
        settings = main.find(f"{MAIN}workbookPr")
        first_day = FIRST_DAY_1904 if settings is not None and settings.get("date1904") in ("1", "true") else FIRST_DAY
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(
            book.read("xl/_rels/workbook.xml.rels")).findall(f"{PACKAGE}Relationship")}
        for sheet in main.iter(f"{MAIN}sheet"):
            part = posixpath.normpath(posixpath.join("/xl", targets[sheet.get(f"{RELATION}id")])).lstrip("/")
            name, done, wanted = sheet.get("name", ""), 0, []
            for cells in _plain_rows(book, part, shared):
                if cells is None:
                    rows = islice(_rows(book, part, strings), done, None)
                    if not done:
                        wanted = _placed({place: text for place, (_, text) in next(rows, {}).items()}, kind)
                    for columns in _parsed_columns(rows, wanted, first_day):
                        yield name, columns
                    break
                if not done:
                    first = np.flatnonzero(cells.row == 0)
                    wanted = _placed(dict(zip(cells.place[first].tolist(), cells.text.take(pa.array(first)).to_pylist())), kind)
                columns = _columns(cells, wanted, first_day, skipped=0 if done else 1)
                done += cells.rows
                if len(columns[-1]):
                    yield name, columns


def sheet_rows(content: bytes, kind: T.StructType) -> Iterator[tuple[str, list[object], int]]:
    """(sheet, declared columns, unreadable cells) of every row of ``sheet_columns``."""
    for sheet, columns in sheet_columns(content, kind):
        for *values, bad in zip(*(c.to_pylist() for c in columns)):
            yield sheet, values, bad


def read_workbooks(files: DataFrame, kind: T.StructType) -> DataFrame:
    """path, sheet, the declared columns (texts, doubles, dates) and ``_bad_cells`` of every row of every sheet.

    ``files`` has the columns path and content. Only declared headings are taken out of the sheets, so declare the
    columns in use. A cell that isn't of its type, or holds an error, is NULL and counted. A file that is no workbook
    is an error; a null content has no rows.
    """
    fields = [T.StructField("path", T.StringType()), T.StructField("sheet", T.StringType()), *kind, T.StructField(BAD_CELLS, T.IntegerType())]
    shape = pa.schema([(f.name, ARROW_TYPES[type(f.dataType)]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = (batch.column(c)[i].as_py() for c in ("path", "content"))
                for sheet, columns in sheet_columns(content, kind) if content is not None else ():
                    same = [pa.repeat(pa.scalar(v, pa.string()), len(columns[-1])) for v in (path, sheet)]
                    yield pa.RecordBatch.from_arrays([*same, *columns], schema=shape)
    return files.select("path", "content").mapInArrow(run, T.StructType(fields))


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks of a folder or glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def read_price_workbooks(files: DataFrame) -> DataFrame:
    """Price sheets with renamed columns and the fund type, which is the sheet's name."""
    return read_workbooks(files, schema.PRICE_SHEET).withColumnsRenamed(schema.PRICE_NAMES | {"sheet": "fund_type"})


def read_allocation_workbooks(files: DataFrame) -> DataFrame:
    """Allocation sheets with renamed columns and the fund type, without the name that the prices carry."""
    sheets = read_workbooks(files, schema.ALLOCATION_SHEET)
    return sheets.withColumnsRenamed(schema.ALLOCATION_KEYS | schema.ALLOCATION_NAMES | {"sheet": "fund_type"}).drop("name")


def bad_cells(rows: DataFrame) -> DataFrame:
    """Per sheet of ``read_workbooks``: rows with unreadable cells, and the cells; sheets without any are left out."""
    return rows.filter(F.col(BAD_CELLS) > 0).groupBy("path", "sheet").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(BAD_CELLS).alias("cells"))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, dt.date):
        return f'<c s="1"><v>{(value - FIRST_DAY).days}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _row(values: Iterable[object]) -> str:
    return "<row>" + "".join(map(_cell, values)) + "</row>"


def _cells_of(column: pa.Array) -> pa.Array:
    """What ``_cell`` gives for each value of a column; a number may be spelled otherwise."""
    kind, before, after = column.type, "<c><v>", "</v></c>"
    if pa.types.is_date32(kind):
        before, text = '<c s="1"><v>', pc.add(column.cast(pa.int32()).cast(pa.int64()), (EPOCH - FIRST_DAY).days).cast(pa.string())
    elif pa.types.is_floating(kind):
        text = column.cast(pa.float64()).cast(pa.string())
    elif pa.types.is_integer(kind):
        text = column.cast(pa.string())
    elif pa.types.is_string(kind):
        before, text, after = '<c t="inlineStr"><is><t xml:space="preserve">', column, "</t></is></c>"
        for entity in ("&amp;", "&gt;", "&lt;"):
            text = pc.replace_substring(text, ENTITIES[entity], entity)
    else:
        return pa.array(map(_cell, column.to_pylist()), pa.string())
    return pc.fill_null(pc.binary_join_element_wise(before, text, after, ""), "<c/>")


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of sheets, each a name with headings and rows of texts, numbers, dates and None."""
    return _packed({name: "".join(map(_row, [headings, *rows])) for name, (headings, rows) in sheets.items()})


def _packed(sheets: dict[str, str]) -> bytes:
    """A workbook of sheets, each a name with its rows."""
    def xml(body: str) -> str:
        return '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body

    def spaced(tag: str, uri: str) -> str:
        return f'<{tag} xmlns="{uri.strip("{}")}"'

    office = RELATION.strip("{}")
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{kinds}styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": spaced("Relationships", PACKAGE) + f'><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": spaced("workbook", MAIN) + f' xmlns:r="{office}"><sheets>'
            + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(numbers, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": spaced("Relationships", PACKAGE) + ">"
            + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
            + f'<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        # style 1 is the built-in date format
        "xl/styles.xml": spaced("styleSheet", MAIN) + '><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    for i, lines in zip(numbers, sheets.values()):
        parts[f"xl/worksheets/sheet{i}.xml"] = spaced("worksheet", MAIN) + f"><sheetData>{lines}</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        for name, body in parts.items():
            book.writestr(name, xml(body))
    return out.getvalue()


def to_workbooks(df: DataFrame, sheet: str) -> DataFrame:
    """Workbooks as rows (path, content): one per Arrow batch of ``df``, with a sheet for each value of the column ``sheet``.

    The rows need no shuffle, and a batch bounds what a task holds. Columns are texts, numbers and dates; a null sheet
    name becomes empty.
    """
    columns = [c for c in df.columns if c != sheet]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pc.binary_join_element_wise("<row>", *(_cells_of(batch.column(c)) for c in columns), "</row>", "")
            names = pc.fill_null(batch.column(sheet), "").dictionary_encode()
            content = _packed({
                name: _row(columns) + "".join(rows.filter(pc.equal(names.indices, i)).to_pylist())
                for i, name in enumerate(names.dictionary.to_pylist())})
            name = f"{hashlib.sha256(content).hexdigest()}.xlsx"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])
    return df.mapInArrow(run, "path string, content binary")

