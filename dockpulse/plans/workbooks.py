"""Workbooks made from a table, as input for trying out the workbook reader."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime
from io import BytesIO
from itertools import chain
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

import pandas as pd
from pandas.api.types import is_datetime64_any_dtype
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# The parts of a minimal workbook; cell style 1 is a date with time.
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PARTS = {
    "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="{_REL}"><sheets>'
    '<sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": "<Relationships "
    'xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/>'
    "</Relationships>",
    "xl/styles.xml": f'<styleSheet {_MAIN}><cellXfs count="2"><xf numFmtId="0"/>'
    '<xf numFmtId="22"/></cellXfs></styleSheet>',
}
_DAY_ZERO = datetime(1899, 12, 30)


def _cell(value: object) -> str:
    if type(value) is str:
        return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    if value is None or value is pd.NaT or value != value:
        return "<c/>"
    if isinstance(value, datetime):
        days = (value - _DAY_ZERO).total_seconds() / 86400
        return f'<c s="1"><v>{days!r}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def _column_cells(column: pd.Series) -> list[str]:
    """The cells of a whole column; equal times are written once."""
    if not is_datetime64_any_dtype(column.dtype):
        return [_cell(v) for v in column.astype(object)]
    of, times = pd.factorize(column)
    written = [*(_cell(v) for v in times), _cell(None)]
    return [written[i] for i in of.tolist()]


def workbook_bytes(columns: Iterable[str], rows: Iterable[Iterable[object]]) -> bytes:
    return _book("".join(_cell(v) for v in row) for row in [list(columns), *rows])


def table_bytes(table: pd.DataFrame) -> bytes:
    """The workbook of a table, written column by column."""
    columns = [_column_cells(table.iloc[:, i]) for i in range(table.shape[1])]
    header = "".join(map(_cell, table.columns))
    return _book(chain([header], map("".join, zip(*columns))))


def _book(lines: Iterable[str]) -> bytes:
    sheet = "".join(f"<row>{line}</row>" for line in lines)
    buffer = BytesIO()
    with ZipFile(buffer, "w", ZIP_DEFLATED, compresslevel=1) as archive:
        for name, text in _PARTS.items():
            archive.writestr(name, text)
        archive.writestr(
            "xl/worksheets/sheet1.xml",
            f"<worksheet {_MAIN}><sheetData>{sheet}</sheetData></worksheet>",
        )
    return buffer.getvalue()


def scan_workbooks(report: DataFrame) -> DataFrame:
    """(path, content) with one workbook per Arrow batch of the report, spread over all cores."""
    cores = report.sparkSession.sparkContext.defaultParallelism

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            name = f"ZMDESNR_{task}_{number}.xlsx"
            yield pd.DataFrame({"path": [name], "content": [table_bytes(batch)]})

    return report.repartition(cores, F.col(f"`{report.columns[0]}`")).mapInPandas(encode, "path string, content binary")
