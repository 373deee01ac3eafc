"""Workbooks (xlsx): a reader of their sheets as tables, and a data source that writes them.

    table = workbooks.read_workbook(spark, "/tables/*.xlsx", sheet="People", schema="id int, born date")
    workbooks.register(spark)
    df.write.format("workbook").mode("overwrite").save("/tables")

A workbook is one task's work: its parts are inflated as a stream, row by row, beside its table of shared texts. Files are
opened by Spark, so any store does (at most 2 GB each); a worker holds the file that it reads, so the writer starts a new
one after ``rowsPerFile`` rows (an option, 100000): how many rows there are decides how many files, not how large they are.
"""

from __future__ import annotations

import datetime
import functools
import io
import math
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..session import byte_batches, ship_package
from .volumes import VolumeWriter, Written, _store

ROWS = "path string, sheet string, row long, cells array<struct<column:int, name:string, kind:string, value:string>>, error string"
_CELL = pa.struct([("column", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("value", pa.string())])
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(_CELL)), ("error", pa.string())])

# Fixed values of the format: numbers of built-in formats that are dates or times, limits of a sheet and of a cell.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MOST_ROWS, MOST_CHARS = 1048576, 32767
#: Rows of a file, its heading not counted, where the writer is not told otherwise.
FILE_ROWS = 100000
#: Days from the first day of a workbook's calendar to 1970-01-01.
EPOCH = {"date": 25569, "date1904": 24107}
BATCH = 1000
#: So many different texts of a file are written once; further ones stand in their cells.
SHARED_TEXTS = 10000


class NotAWorkbook(ValueError):
    """The bytes are no workbook, or a part of it is missing or broken."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attributes(element: ElementTree.Element) -> dict[str, str]:
    return {_local(k): v for k, v in element.attrib.items()}


def _plain(text: str) -> str:
    """Text with its escapes ``_x000D_`` undone."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text_of(element: ElementTree.Element) -> str:
    """The text of a string item: its runs one after the other, without readings."""
    out = []
    for child in element:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return _plain("".join(out))


def _related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """By id, the type and the path of the parts that ``part`` names."""
    folder, name = posixpath.split(part)
    listing = posixpath.join(folder, "_rels", f"{name}.rels")
    if listing not in book.namelist():
        return {}
    links = [_attributes(x) for x in ElementTree.fromstring(book.read(listing)) if x.get("TargetMode") != "External"]
    return {x["Id"]: (x["Type"].rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("/", folder, x["Target"])).lstrip("/")) for x in links}


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: a letter of one outside quotes, escapes and brackets, or an
    elapsed time in brackets."""
    code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", code, re.IGNORECASE):
        return True
    return bool(re.search("[dmyhs]", re.sub(r"\[[^\]]*\]|general", "", code, flags=re.IGNORECASE), re.IGNORECASE))


def _date_styles(book: zipfile.ZipFile, part: str | None) -> set[int]:
    """The cell styles that show dates."""
    if part is None:
        return set()
    root = ElementTree.fromstring(book.read(part))
    own = {int(x.get("numFmtId")): is_date_format(x.get("formatCode", "")) for x in root.iter() if _local(x.tag) == "numFmt"}
    used = [x for group in root if _local(group.tag) == "cellXfs" for x in group]
    ids = [int(x.get("numFmtId") or 0) for x in used]
    return {i for i, n in enumerate(ids) if own.get(n, n in DATE_FORMATS)}


def _shared_texts(book: zipfile.ZipFile, part: str | None) -> list[str]:
    if part is None:
        return []
    out, root = [], None
    with book.open(part) as f:
        for event, x in ElementTree.iterparse(f, ("start", "end")):
            root = x if root is None else root
            if event == "end" and _local(x.tag) == "si":
                out.append(_text_of(x))
                root.clear()
    return out


def _column(reference: str) -> int:
    """The number of a reference's column, from 1."""
    return _number(re.match("[A-Za-z]*", reference)[0])


@functools.lru_cache(20000)
def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def _cell(x: ElementTree.Element, texts: list[str], dates: set[int], calendar: str) -> tuple[str, str] | None:
    """(kind, value) of a cell; None where it is blank or holds an error."""
    kind = x.get("t", "n")
    if kind == "inlineStr":
        found = next((y for y in x if _local(y.tag) == "is"), None)
        return None if found is None else ("text", _text_of(found))
    value = next((y.text for y in x if _local(y.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return "text", texts[int(value)]
    if kind == "str":
        return "text", _plain(value)
    if kind == "b":
        return "boolean", "true" if value.strip() in ("1", "true") else "false"
    if kind == "d":
        return "text", value
    return calendar if int(x.get("s", 0)) in dates else "number", value.strip()


def _sheet_rows(stream: io.BufferedIOBase, *how) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:  # noqa: ANN002
    """(row, cells by column) of the rows that hold something; where a place is not given, it follows the last."""
    row, held = 0, None
    for event, x in ElementTree.iterparse(stream, ("start", "end")):
        tag = _local(x.tag)
        if event == "start":
            held = x if tag == "sheetData" else held
        elif tag == "row":
            row, column, cells = int(x.get("r", row + 1)), 0, {}
            for c in x:
                column = _column(c.get("r", "")) or column + 1
                found = _cell(c, *how)
                if found is not None:
                    cells[column] = found
            if held is not None:
                held.clear()
            if cells:
                yield row, cells


def _names(cells: dict[int, tuple[str, str]]) -> dict[int, str]:
    """Names of columns from a heading: repeated ones are numbered, blank ones are called by their place."""
    out, seen = {}, set()
    for column, (_, value) in sorted(cells.items()):
        name, n = value, 1
        while name in seen:
            n += 1
            name = f"{value}_{n}"
        seen.add(name)
        out[column] = name
    return out


def sheets(content: bytes | pa.NativeFile, sheet: str | int | None = None, heading_only: bool = False) -> Iterator[tuple[str, int, list[dict]]]:
    """(sheet, row, cells) below the headings of a workbook's sheets (all, one by its name, or by its place from 0), each cell
    with its column's name; with ``heading_only`` the headings themselves. The heading is the first row that holds something."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        top = next((path for kind, path in _related(book, "").values() if kind == "officeDocument"), "xl/workbook.xml")
        root, links = ElementTree.fromstring(book.read(top)), _related(book, top)
        part = lambda kind: next((path for k, path in links.values() if k == kind), None)
        listed = [_attributes(x) for x in root.iter() if _local(x.tag) == "sheet"]
        late = any(_attributes(x).get("date1904") in ("1", "true") for x in root.iter() if _local(x.tag) == "workbookPr")
        how = _shared_texts(book, part("sharedStrings")), _date_styles(book, part("styles")), "date1904" if late else "date"
        for place, one in enumerate(listed):
            kind, path = links[one["id"]]
            if kind != "worksheet" or sheet not in (None, place, one["name"]):
                continue
            names = None
            with book.open(path) as f:
                for row, cells in _sheet_rows(f, *how):
                    if names is None:
                        names = _names(cells)
                        if heading_only:
                            yield one["name"], row, [{"column": c, "name": n, "kind": "text", "value": n} for c, n in names.items()]
                            break
                        continue
                    yield one["name"], row, [{"column": c, "name": names.get(c, f"column_{c}"), "kind": k, "value": v} for c, (k, v) in sorted(cells.items())]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, OSError, zipfile.zlib.error) as error:
        raise NotAWorkbook(str(error) or type(error).__name__) from error


def read_rows(spark: SparkSession, path: str, sheet: str | int | None = None, heading_only: bool = False) -> DataFrame:
    """(path, sheet, row, cells, error): a row for each one below a heading; a file that is no workbook has one with its
    ``error``, after the rows that could be read. Rows that hold nothing are none; Spark lists no files of no bytes."""

    def batch_of(path: str, held: list[tuple]) -> pa.RecordBatch:
        names, numbers, lists, errors = ([x[i] for x in held] for i in range(4))
        cells = [c for x in lists for c in x or ()]
        fields = [pa.array([c[f.name] for c in cells], f.type) for f in _CELL]
        ends = np.cumsum([0, *(len(x or ()) for x in lists)])
        at = pa.array(ends, pa.int32(), mask=np.array([*(x is None for x in lists), False]))
        columns = [pa.array([path] * len(held), pa.string()), pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, fields=list(_CELL))), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                try:
                    # the file stays where Arrow has it
                    for name, row, cells in sheets(pa.BufferReader(content.as_buffer()) if content.is_valid else b"", sheet, heading_only):
                        held.append((name, row, cells, None))
                        if len(held) == BATCH:
                            yield batch_of(file.as_py(), held)
                            held = []
                except NotAWorkbook as error:
                    held.append((None, None, None, str(error)))
                yield batch_of(file.as_py(), held)

    ship_package(spark)
    byte_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!~.]*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(rows, ROWS)


def cell_text(cell: Column) -> Column:
    """A cell as text: whole numbers without a point, dates as 2001-02-03 with 04:05:06 where there is a time of day, times
    alone as 04:05:06. Days before March of 1900 are those that spreadsheets show."""
    kind, number = cell["kind"], cell["value"].try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    seconds = F.round(number * 86400).cast("long")
    day, second = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    early = F.when((kind == "date") & (day < 60), 1).otherwise(0)
    epoch = F.when(kind == "date", EPOCH["date"]).otherwise(EPOCH["date1904"])
    date = F.date_add(F.lit(datetime.date(1970, 1, 1)), day - epoch + early).cast("string")
    time = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    moment = F.when(second == 0, date).when(day == 0, time).otherwise(F.concat_ws(" ", date, time))
    return F.when(kind == "number", F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).when(kind.startswith("date"), moment).otherwise(cell["value"])


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = 0, schema: T.StructType | str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """The sheets of the workbooks under ``path`` as one table, by the names in their headings, in any order of columns.

    With a ``schema`` its columns are cast (what can not be is null) and others are left out; without, all names of all
    headings are columns of text, in order of place, and only headings are read to find them. A column that a
    workbook lacks is null. Files that are no workbooks give no rows, or with mode FAILFAST stop the job.
    """
    if schema is None:
        heads = read_rows(spark, path, sheet, heading_only=True).select(F.explode("cells").alias("c")).groupBy("c.name").agg(F.min("c.column").alias("at"))
        wanted = T.StructType([T.StructField(r["name"], T.StringType()) for r in heads.orderBy("at", "name").collect()])  # names of columns only
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = read_rows(spark, path, sheet)
    if mode == "FAILFAST":
        rows = rows.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean")))
    values = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["name"], cell_text(c))))
    table = rows.filter("cells is not null").select(values.alias("_v"))
    return table.select(*[F.try_element_at("_v", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


# --- writing -----------------------------------------------------------------------------------------------------
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _links(*parts: tuple[str, str]) -> str:
    body = "".join(f'<Relationship Id="rId{i}" Type="{_LINK}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(parts, 1))
    return f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{body}</Relationships>'


def _escaped(text: str) -> str:
    if len(text) > MOST_CHARS:
        raise ValueError(f"a cell holds at most {MOST_CHARS} characters, not {len(text)}")
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


@functools.lru_cache(20000)
def letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


class Book:
    """A workbook of one sheet that is written row by row."""

    def __init__(self, target: io.BufferedIOBase, names: list[str], sheet: str = "Sheet1") -> None:
        self.zip, self.texts, self.rows = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED), {}, 0
        kinds = {"workbook.xml": "sheet.main", "worksheets/sheet1.xml": "worksheet", "styles.xml": "styles", "sharedStrings.xml": "sharedStrings"}
        types = "".join(f'<Override PartName="/xl/{p}" ContentType="{_KIND}.{k}+xml"/>' for p, k in kinds.items())
        put = self.zip.writestr
        put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        put("_rels/.rels", _links(("officeDocument", "xl/workbook.xml")))
        put("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", _links(("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml"), ("sharedStrings", "sharedStrings.xml")))
        styles = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (0, 14, 22))
        fixed = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        put("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}">{fixed}<cellXfs count="3">{styles}</cellXfs></styleSheet>')
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.add(names)

    def _cell(self, place: str, v: object) -> str:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return ""
        if isinstance(v, bool):
            return f'<c r="{place}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime.date):
            full = isinstance(v, datetime.datetime)
            days = (v.replace(tzinfo=None) if full else datetime.datetime(v.year, v.month, v.day)) - datetime.datetime(1970, 1, 1)
            serial = days / datetime.timedelta(days=1) + EPOCH["date"]
            return f'<c r="{place}" s="{2 if full else 1}"><v>{serial - (serial < 61)!r}</v></c>'
        if isinstance(v, str):
            if v in self.texts or len(self.texts) < SHARED_TEXTS:
                return f'<c r="{place}" t="s"><v>{self.texts.setdefault(v, len(self.texts))}</v></c>'
            return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{_escaped(v)}</t></is></c>'
        return f'<c r="{place}"><v>{v}</v></c>'

    def add(self, values: list) -> None:
        self.rows += 1
        cells = "".join(self._cell(f"{letters(i)}{self.rows}", v) for i, v in enumerate(values, 1))
        self.sheet.write(f'<row r="{self.rows}">{cells}</row>'.encode())

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        items = "".join(f'<si><t xml:space="preserve">{_escaped(t)}</t></si>' for t in self.texts)
        self.zip.writestr("xl/sharedStrings.xml", f'{_HEAD}<sst xmlns="{_MAIN}">{items}</sst>')
        self.zip.close()


class WorkbookWriter(VolumeWriter):
    """A task's rows become workbooks of ``rowsPerFile`` rows at most; they appear together when all tasks have ended.
    Nested values are the caller's to turn into text; times are written as they read in UTC."""

    written = "*.xlsx"

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.most = min(int(next((v for k, v in options.items() if k.lower() == "rowsperfile"), FILE_ROWS)), MOST_ROWS - 1)
        if self.most < 1:
            raise ValueError(f"rowsPerFile is {self.most}, not 1 or more")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        folder, names, book = f"{top}/.volumes-{self.job}/{uuid.uuid4().hex}", [], None
        store.create_dir(folder, recursive=True)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                if book is not None and book.rows > self.most:
                    book.close()
                    target.close()  # noqa: F821
                    book = None
                if book is None:
                    names.append(f"part-{uuid.uuid4().hex}.xlsx")
                    target = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    book = Book(target, batch.schema.names)
                book.add(list(values))
        if book is not None:
            book.close()
            target.close()
        return Written(folder, names)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:  # noqa: ANN001
        return WorkbookWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WorkbookSource)
