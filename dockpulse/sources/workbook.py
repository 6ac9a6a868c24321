"""Workbooks (.xlsx) as tables.

Spark lists and distributes the files; each task decodes its workbooks row by row and returns
cells as text keyed by header. A workbook cannot be split, but the format limits a sheet to
1,048,576 rows, so the work of one task is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from io import BytesIO
from math import isfinite
from xml.etree import ElementTree
from zipfile import BadZipFile, ZipFile
from zlib import error as ZlibError

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dockpulse.operators.headers import report_header

_ROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("row_number", pa.int32()),
        ("cells", pa.map_(pa.string(), pa.string())),
    ]
)
_ROWS_PER_BATCH = 5000
#: What damaged, encrypted or unfinished archives and parts raise.
_DAMAGE = (
    BadZipFile,
    ElementTree.ParseError,
    EOFError,
    KeyError,
    NotImplementedError,
    RuntimeError,
    ValueError,
    ZlibError,
)
#: Fixed value: columns of a sheet at most.
MAX_COLUMNS = 16384

# Built-in number formats of the workbook format that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


class _Memo(dict):
    """What a function gave for each key it was asked for; for few distinct keys."""

    def __init__(self, function: Callable):
        self._function = function

    def __missing__(self, key):
        value = self[key] = self._function(key)
        return value


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _nodes(archive: ZipFile, name: str, wanted: set[str]) -> Iterator[ElementTree.Element]:
    """Finished elements with a wanted name, released after use."""
    is_wanted = _Memo(lambda tag: _local(tag) in wanted)
    with archive.open(name) as part:
        for _, node in ElementTree.iterparse(part):
            if is_wanted[node.tag]:
                yield node
                node.clear()


def _text(node: ElementTree.Element, local: Mapping[str, str]) -> str:
    """Text of a string item with its rich text runs, without phonetic hints."""
    if len(node) == 1 and local[node[0].tag] == "t":
        return node[0].text or ""
    parts = []
    for child in node:
        name = local[child.tag]
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts.extend(t.text or "" for t in child if local[t.tag] == "t")
    return "".join(parts)


def _date_styles(archive: ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    custom, styles = set(_DATE_FORMATS), set()
    for node in _nodes(archive, "xl/styles.xml", {"numFmts", "cellXfs"}):
        for index, child in enumerate(node):
            number = int(child.get("numFmtId", 0))
            if _local(node.tag) == "cellXfs":
                if number in custom:
                    styles.add(index)
            elif re.search(r"[dmyhs]", _QUOTED.sub("", child.get("formatCode", "")).lower()):
                custom.add(number)
    return styles


def _first_sheet(archive: ZipFile) -> tuple[str, bool]:
    """Part that holds the first sheet, and whether days count from 1904."""
    relation, from_1904 = None, False
    for node in _nodes(archive, "xl/workbook.xml", {"workbookPr", "sheet"}):
        if _local(node.tag) == "workbookPr":
            from_1904 = node.get("date1904") in ("1", "true")
        elif relation is None:
            relation = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
    for node in _nodes(archive, "xl/_rels/workbook.xml.rels", {"Relationship"}):
        if node.get("Id") == relation:
            target = node.get("Target", "")
            return (target[1:] if target.startswith("/") else f"xl/{target}"), from_1904
    raise ValueError("workbook without a sheet")


def _date_text(number: float, from_1904: bool) -> str | None:
    """Day count with fraction as text; a count below one is a time of day, which never rounds up
    to the next day. Counts outside the calendar give nothing."""
    if not isfinite(number):
        return None
    seconds = round(number * 86400)
    if 0 <= number < 1 and not from_1904:
        return str(timedelta(seconds=min(seconds, 86399))).rjust(8, "0")
    origin = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    try:
        return str(origin + timedelta(seconds=seconds))
    except (OverflowError, ValueError):
        return None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _column(reference: str) -> int:
    index = 0
    for sign in reference:
        if not sign.isalpha():
            break
        index = index * 26 + ord(sign.upper()) - 64
    return index - 1


def _shared_strings(archive: ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    local = _Memo(_local)
    return [_text(n, local) for n in _nodes(archive, "xl/sharedStrings.xml", {"si"})]


def _sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Rows of the first sheet as column number to text; empty cells, and those that refer to
    nothing or hold no number where one is due, are left out. The table of shared strings is read
    when a cell first refers to it."""
    with ZipFile(BytesIO(content)) as archive:
        shared: list[str] | None = None
        dates = _date_styles(archive)
        is_date = _Memo(lambda style: _number(style) in dates)
        sheet, from_1904 = _first_sheet(archive)
        local = _Memo(_local)
        for row in _nodes(archive, sheet, {"row"}):
            cells = {}
            for position, cell in enumerate(row):
                get = cell.get
                column = _column(reference) if (reference := get("r")) else position
                kind, part = get("t", "n"), None
                holder = "is" if kind == "inlineStr" else "v"
                for child in cell:
                    if local[child.tag] == holder:
                        part = child
                if part is None or kind == "e":
                    continue
                text = _text(part, local) if kind == "inlineStr" else part.text
                if text is None:
                    continue
                if kind == "s":
                    shared = _shared_strings(archive) if shared is None else shared
                    number = _number(text)
                    known = number is not None and 0 <= number < len(shared)
                    text = shared[int(number)] if known else None
                elif kind == "n" and is_date[get("s", "0")]:
                    number = _number(text)
                    text = None if number is None else _date_text(number, from_1904)
                if text:
                    cells[column] = text
            yield cells


def _named_columns(first_row: Mapping[int, str]) -> dict[int, str]:
    """Column names by the header row. Equal headers are numbered from the second on, so that no
    column hides another."""
    names: dict[int, str] = {}
    for column in sorted(first_row):
        name = report_header(first_row[column])
        number, plain = 1, name
        while name in names.values():
            number += 1
            name = f"{plain}_{number}"
        names[column] = name
    return names


def _batch(rows: list[tuple[str, int, list[tuple[str, str]]]]) -> pa.RecordBatch:
    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), _ROW_SCHEMA.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_ROW_SCHEMA)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = _sheet_rows(content.as_py())
            names = _named_columns(next(rows, {}))
            pending = []
            for number, cells in enumerate(rows, start=1):
                named = [(names.get(c, f"column_{c + 1}"), text) for c, text in cells.items()]
                pending.append((path.as_py(), number, named))
                if len(pending) == _ROWS_PER_BATCH:
                    yield _batch(pending)
                    pending = []
            if pending:
                yield _batch(pending)


def _table_decoder(columns: Sequence[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decodes the named columns into arrays of their own. Of several cells with one name the first
    of the row counts."""
    places: dict[str, int] = {}
    for name in columns:
        places.setdefault(name, len(places))
    fields = pa.schema([(str(place), pa.string()) for place in places.values()])

    def batch(rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=fields)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                rows = _sheet_rows(content.as_py())
                names = _named_columns(next(rows, {}))
                place = _Memo(lambda c, names=names: places.get(names.get(c, f"column_{c + 1}")))
                pending = []
                for cells in rows:
                    row = [None] * len(places)
                    for column, text in cells.items():
                        at = place[column]
                        if at is not None and row[at] is None:
                            row[at] = text
                    pending.append(row)
                    if len(pending) == _ROWS_PER_BATCH:
                        yield batch(pending)
                        pending = []
                if pending:
                    yield batch(pending)

    return decode


def _decode_headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names: set[str] = set()
        for content in batch.column("content"):
            names.update(_named_columns(next(_sheet_rows(content.as_py()), {})).values())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], ["name"])


def workbook_rows(files: DataFrame) -> DataFrame:
    """Data rows of every workbook in ``files`` (path, content): the first sheet, its first row
    taken as the header. Cells are keyed by the cleaned header, those below no header by their
    place (``column_4``), which ``workbook_table`` reads if asked for; dates and times come as
    'yyyy-MM-dd HH:mm:ss' and 'HH:mm:ss'."""
    return files.select("path", "content").mapInArrow(
        _decode, "path string, row_number int, cells map<string,string>"
    )


def workbook_columns(files: DataFrame) -> list[str]:
    """Cleaned headers found in the files. Of each file only the sheet's first row is decoded, with
    the shared strings where it refers to them, and only the distinct names reach the driver: no
    more than a sheet can have columns."""
    names = files.select("content").mapInArrow(_decode_headers, "name string").distinct()
    found = sorted(row.name for row in names.limit(MAX_COLUMNS + 1).collect())
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"the workbooks have more than {MAX_COLUMNS} different headers")
    return found


def unreadable_workbooks(files: DataFrame) -> list[tuple[str, str]]:
    """(path, error) of the workbooks that are no complete archive or have no readable first sheet.
    Every part is held against its checksum and the sheet parsed to its end, in the tasks, so that
    damage anywhere is found before a refresh relies on the file."""

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                try:
                    with ZipFile(BytesIO(content.as_py())) as archive:
                        if (part := archive.testzip()) is not None:
                            raise BadZipFile(f"{part} is damaged")
                    for _ in _sheet_rows(content.as_py()):
                        pass
                except _DAMAGE as error:
                    bad.append((path.as_py(), f"{type(error).__name__}: {error}"))
            columns = [pa.array(c, pa.string()) for c in zip(*bad)] if bad else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(columns, ["path", "error"])

    found = files.select("path", "content").mapInArrow(probe, "path string, error string")
    return [(row.path, row.error) for row in found.collect()]


def workbook_table(files: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Workbook rows as text columns. Give ``columns`` to plan without opening the files; a column
    that a file lacks is null there."""
    names = list(workbook_columns(files) if columns is None else columns)
    if not names:
        return workbook_rows(files).select()
    distinct = list(dict.fromkeys(names))
    schema = T.StructType([T.StructField(str(i), T.StringType()) for i in range(len(distinct))])
    table = files.select("content").mapInArrow(_table_decoder(names), schema)
    return table.select(*[F.col(str(distinct.index(n))).alias(n) for n in names])
