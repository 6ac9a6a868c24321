import os
import subprocess
import sys
from datetime import datetime
from io import BytesIO
from zipfile import ZipFile

import pandas as pd
import pytest
from conftest import ROOT
from helpers import plan, rows

from dockpulse.plans.workbooks import scan_workbooks, table_bytes, workbook_bytes
from dockpulse.sources.files import classify_files, latest_file, list_files
from dockpulse.sources.reports import load_report, read_scans
from dockpulse.sources.workbook import (
    _date_text,
    _sheet_rows,
    unreadable_workbooks,
    workbook_columns,
    workbook_rows,
    workbook_table,
)

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def office_workbook(sheet: str, date1904: bool = False) -> bytes:
    """A workbook the way office programs write it: shared strings, styles, two sheets."""
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{REL}">'
        f'<workbookPr date1904="{int(date1904)}"/><sheets>'
        '<sheet name="Data" sheetId="7" r:id="rId9"/><sheet name="Other" sheetId="1" r:id="rId1"/>'
        "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships "
        'xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/other.xml"/>'
        '<Relationship Id="rId9" Target="/xl/worksheets/data.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>Serial #</t></si><si><t>Created on</t></si>"
        "<si><r><t>Ti</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si><si><t>S&amp;1</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="hh:mm:ss"/>'
        '<numFmt numFmtId="165" formatCode="&quot;days&quot;0.0[Red]"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/>'
        "</cellXfs></styleSheet>",
        "xl/worksheets/data.xml": f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>",
        "xl/worksheets/other.xml": f"<worksheet {MAIN}><sheetData/></worksheet>",
    }
    buffer = BytesIO()
    with ZipFile(buffer, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return buffer.getvalue()


SHEET = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c>'
    '<c r="AA1" t="inlineStr"><is><t>Wide</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2" s="1"><v>45352</v></c>'
    '<c r="C2" s="2"><v>0.4305555555555556</v></c><c r="AA2" s="3"><v>1.5</v></c></row>'
    '<row r="3"><c r="C3" t="e"><v>#N/A</v></c></row>'
    '<row r="4"><c r="A4"><v>1001</v></c><c r="B4" s="1"><v>45352.5</v></c>'
    '<c r="C4" t="str"><v>10:20</v></c><c r="AA4" t="b"><v>1</v></c></row>'
)


def test_cells_of_an_office_workbook():
    assert list(_sheet_rows(office_workbook(SHEET))) == [
        {0: "Serial #", 1: "Created on", 2: "Time", 26: "Wide"},
        {0: "S&1", 1: "2024-03-01 00:00:00", 2: "10:20:00", 26: "1.5"},
        {},
        {0: "1001", 1: "2024-03-01 12:00:00", 2: "10:20", 26: "1"},
    ]


def test_days_counted_from_1904():
    sheet = '<row><c t="str"><v>d</v></c></row><row><c s="1"><v>0</v></c></row>'
    assert list(_sheet_rows(office_workbook(sheet, date1904=True)))[1] == {0: "1904-01-01 00:00:00"}


def test_empty_sheet(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(office_workbook("")))], "path string, content binary")
    assert workbook_columns(files) == []
    assert workbook_rows(files).count() == 0


def test_rows_of_many_workbooks(spark):
    books = [
        ("a.xlsx", bytearray(workbook_bytes(["Serial #", "Qty"], [(f"A{i}", i) for i in range(12000)]))),
        ("b.xlsx", bytearray(workbook_bytes(["SERIAL #", "Shipping Point/Receiving Pt"], [("B<1>", None)]))),
    ]
    files = spark.createDataFrame(books, "path string, content binary").repartition(2)
    assert workbook_columns(files) == ["qty", "serial_number", "shipping_point"]
    decoded = workbook_rows(files)
    assert decoded.count() == 12001
    assert decoded.select("path", "row_number").distinct().count() == 12001
    last = decoded.filter("row_number = 12000").first()
    assert last.cells == {"serial_number": "A11999", "qty": "11999"}
    assert decoded.filter("path = 'b.xlsx'").first().cells == {"serial_number": "B<1>"}


@pytest.fixture()
def inbox(tmp_path):
    columns = ["Serial #", "Created by", "Created on", "Time", "Delivery", "Status"]
    for stamp, name in enumerate(["ZMDESNR_old.xlsx", "zmdesnr_new.XLSX", "VL06O.xlsx", "other.xlsx", "ZMDESNR.csv"]):
        data = [(name, "U1", datetime(2024, 3, 1, 5), "10:20:30", 12.0, "ASH")]
        path = tmp_path / name
        path.write_bytes(workbook_bytes(columns, data))
        os.utime(path, (1700000000 + stamp, 1700000000 + stamp))
    return str(tmp_path)


def test_newest_file_of_each_kind(spark, inbox):
    listing = classify_files(list_files(spark, inbox))
    assert listing.filter("report_type is null").count() == 2
    newest = {r.report_type: r.path.rsplit("/", 1)[1] for r in latest_file(listing).collect()}
    assert newest == {"scans": "zmdesnr_new.XLSX", "deliveries": "VL06O.xlsx"}


def test_listing_does_not_read_the_files(spark, inbox):
    scan = list_files(spark, inbox)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[1]


def test_scan_report_from_workbooks(spark, inbox):
    scans = read_scans(load_report(spark, f"{inbox}/ZMDESNR_old.xlsx"))
    assert rows(scans, "serial_number", "delivery", "scan_timestamp", "created_on") == [
        ("ZMDESNR_old.xlsx", "12", datetime(2024, 3, 1, 10, 20, 30), datetime(2024, 3, 1, 5))
    ]
    assert load_report(spark, f"{inbox}/*.xlsx").count() == 3


def test_workbooks_made_by_tasks(spark):
    serial, time = "concat('S', id) as `Serial #`", "timestamp'2024-03-01 10:20:30' as t"
    books = scan_workbooks(spark.range(25).selectExpr(serial, time))
    assert books.select("path").distinct().count() == books.count() > 1
    assert workbook_rows(books).selectExpr("cells['serial_number']", "cells['t']").distinct().count() == 25
    assert workbook_rows(books).first().cells["t"] == "2024-03-01 10:20:30"


def test_tasks_need_no_installed_package(tmp_path):
    """The driver finds the package by path only; workers started elsewhere must cope."""
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from dockpulse import build_session\n"
        "from dockpulse.plans.workbooks import scan_workbooks\n"
        "from dockpulse.sources.workbook import workbook_columns\n"
        "spark = build_session('x', 'local[2]', **{'spark.ui.enabled': 'false'})\n"
        "print(workbook_columns(scan_workbooks(spark.range(3))))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200
    )
    assert job.stdout.strip().endswith("['id']"), job.stderr[-2000:]


def test_equal_and_blank_headers_keep_their_columns(spark):
    content = workbook_bytes(["Delivery", "Delivery", None, "Status"], [(1, 2, "x", "ASH"), (None, 7, None, None)])
    files = spark.createDataFrame([("a.xlsx", content)], "path string, content binary")
    assert workbook_columns(files) == ["delivery", "delivery_2", "status"]
    cells = [r.cells for r in workbook_rows(files).orderBy("row_number").collect()]
    assert cells == [
        {"delivery": "1", "delivery_2": "2", "column_3": "x", "status": "ASH"},
        {"delivery_2": "7"},
    ]


def test_times_at_the_end_of_the_day_and_counts_beyond_the_calendar():
    assert _date_text(0.999998, False) == "23:59:59"
    assert _date_text(0.5, False) == "12:00:00"
    assert _date_text(45352.0, False) == "2024-03-01 00:00:00"
    assert _date_text(1e12, False) is None
    assert _date_text(-1e9, True) is None


def test_damage_behind_the_first_row_is_found(spark):
    good = workbook_bytes(["a", "b"], [(i, f"text {i * 7919}") for i in range(20_000)])
    sheet = good.index(b"xl/worksheets")
    middle = (sheet + len(good)) // 2
    damaged = good[:middle] + bytes(200) + good[middle + 200 :]
    encrypted = bytearray(good)
    for at in (encrypted.index(b"PK\x03\x04") + 6, encrypted.index(b"PK\x01\x02") + 8):
        encrypted[at] |= 1
    unfinished = office_workbook(SHEET + "<row>")
    files = spark.createDataFrame(
        [("good", good), ("damaged", damaged), ("encrypted", bytes(encrypted)), ("unfinished", unfinished)],
        "path string, content binary",
    )
    assert sorted(path for path, _ in unreadable_workbooks(files)) == ["damaged", "encrypted", "unfinished"]


def test_cells_that_cannot_be_decoded_are_missing(spark):
    sheet = (
        '<row><c t="s"><v>0</v></c><c t="s"><v>99</v></c><c t="s"><v>x</v></c><c s="1"><v>soon</v></c>'
        '<c s="1"><v>inf</v></c><c s="odd"><v>7</v></c></row>'
    )
    assert list(_sheet_rows(office_workbook(sheet))) == [{0: "Serial #", 5: "7"}]


def test_unreadable_workbooks(spark):
    good = workbook_bytes(["a"], [(1,)])
    files = spark.createDataFrame(
        [("good.xlsx", good), ("cut.xlsx", good[:-30]), ("text.xlsx", b"hello")], "path string, content binary"
    )
    assert sorted(path for path, _ in unreadable_workbooks(files)) == ["cut.xlsx", "text.xlsx"]


def test_tables_are_written_as_their_rows_are():
    table = pd.DataFrame(
        {
            "Text": ["a<b>", None, "", "NaN"],
            "Day": pd.to_datetime(["2024-03-01 10:20:30", None, "2024-03-01 10:20:30", "1999-01-01 00:00:00"]),
            "Number": [1.5, float("nan"), -0.0, 0.0],
            "Whole": [1, 2, 3, 4],
            "Open": pd.Series([True, None, 7, "x"], dtype=object),
        }
    )
    whole = workbook_bytes(table.columns, table.astype(object).itertuples(index=False))
    assert list(_sheet_rows(table_bytes(table))) == list(_sheet_rows(whole))


def test_tables_are_decoded_without_a_map_of_each_row(spark):
    # the second header is numbered, cells below no header are called by their place
    content = workbook_bytes(["Delivery", "Delivery", None, "column_3"], [(1, 2, "x", "y"), (None, 7, None, "z"), (None,) * 4])
    files = spark.createDataFrame([("a.xlsx", bytearray(content))], "path string, content binary")
    names = ["column_3", "delivery", "delivery_2", "nowhere", "delivery"]
    table = workbook_table(files, names)
    assert table.columns == names and "map" not in plan(table.select("column_3")).lower().replace("mapinarrow", "")
    expected = [tuple(r) for r in workbook_rows(files).selectExpr(*[f"cells['{n}']" for n in names]).collect()]
    assert [tuple(r) for r in table.collect()] == expected
    assert expected[0] == ("x", "1", "2", None, "1") and expected[1] == ("z", None, "7", None, None)
