"""Broken packages, parts, records and cells: in each mode, and as rows."""

import struct

import pytest

from gridspark.sources import auto, faults, xls, xlsx
from gridspark.testing import xls_writer, xlsx_writer


def broken(path, sheet, at=b"<sheetData>"):
    raw = bytearray(open(path, "rb").read())
    import zipfile

    with zipfile.ZipFile(path) as z:
        members = {i.filename: z.read(i) for i in z.infolist()}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    raw = bytearray(open(path, "rb").read())
    place = raw.find(members[f"xl/worksheets/{sheet}"]) + members[f"xl/worksheets/{sheet}"].find(at) + 1
    raw[place] ^= 1
    open(path, "wb").write(raw)


def test_a_broken_sheet_ends_nothing(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx_writer.write(path, {"Good": [(1, "x")], "Bad": [(k,) for k in range(50_000)]})
    broken(path, "sheet2.xml", b"</worksheet>")
    with pytest.raises(Exception, match="sheet2.xml"):
        xlsx.cells(spark, path).collect()
    assert {r["sheet"] for r in xlsx.cells(spark, path, mode="permissive").collect()} >= {"Good"} and xlsx.cells(spark, path, mode="permissive").where("sheet = 'Good'").count() == 2
    assert [(r["part"], r["sheet"], r["error"]) for r in faults.workbook_errors(spark, path).collect()] == [("xl/worksheets/sheet2.xml", "Bad", "BadPart")]


def test_every_kind_of_fault(spark, tmp_path):
    xlsx_writer.write(str(tmp_path / "fine.xlsx"), {"s": [(1, "x", "#N/A")]})
    (tmp_path / "cut.xlsx").write_bytes((tmp_path / "fine.xlsx").read_bytes()[:200])
    xls_writer.write(str(tmp_path / "fine.xls"), {"s": [(1, "x")]})
    (tmp_path / "cut.xls").write_bytes(xls_writer.compound(xls_writer.begin(5) + struct.pack("<HH", 6, 500)))
    import zipfile

    with zipfile.ZipFile(tmp_path / "none.xlsx", "w") as z:
        z.writestr("a.xml", "<a/>")
    cells = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>7</v></c><c r="B1" t="e"><v>#WHAT</v></c><c r="C1" t="n"><v>x</v></c><c r="D1"><v>1</v></c></row></sheetData></worksheet>'
    xlsx_writer.write(str(tmp_path / "cells.xlsx"), {"s": []}, parts={})
    with zipfile.ZipFile(tmp_path / "cells.xlsx") as z:
        members = {i.filename: z.read(i) for i in z.infolist()} | {"xl/worksheets/sheet1.xml": cells.encode()}
    with zipfile.ZipFile(tmp_path / "cells.xlsx", "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    found = {(r["path"].rsplit("/", 1)[1], r["sheet"], r["row"], r["col"], r["error"]): r["text"] for r in faults.workbook_errors(spark, str(tmp_path)).collect()}
    assert set(found) == {
        ("cut.xlsx", None, None, None, "BadPackage"), ("none.xlsx", None, None, None, "NoWorkbook"), ("cut.xls", None, None, None, "BadRecord"),
        ("cells.xlsx", "s", 0, 0, "LostString"), ("cells.xlsx", "s", 0, 1, "BadCell"), ("cells.xlsx", "s", 0, 2, "BadCell"),
    }
    assert found["cut.xls", None, None, None, "BadRecord"] == "a record is cut off" and found["cells.xlsx", "s", 0, 1, "BadCell"] == "no value of type e: #WHAT"
    assert faults.workbook_errors(spark, str(tmp_path), cells=False).count() == 3
    kept = auto.cells(spark, str(tmp_path), mode="permissive").groupBy("path").count().collect()
    assert {r["path"].rsplit("/", 1)[1]: r["count"] for r in kept} == {"fine.xlsx": 3, "fine.xls": 2, "cells.xlsx": 1}
    with pytest.raises(Exception, match="no value of type|no shared string"):
        xlsx.cells(spark, str(tmp_path / "cells.xlsx")).collect()
    assert xls.records(spark, str(tmp_path / "fine.xls"), xls.CELL_TYPES, report=True).count() == 0
