"""xls: compound files, records, and a workbook with every kind of cell."""

import datetime as dt
import struct

import pytest

from gridspark import model as M
from gridspark.sources import auto, xls
from gridspark.testing import xls_writer as W


@pytest.mark.parametrize("size", [0, 1, 64, 100, 4095, 4096, 5000, 512 * 127, 300_000])
def test_streams_of_compound_files(size):
    data = bytes(k * 7 % 251 for k in range(size))
    assert xls.workbook_stream(memoryview(W.compound(data))) == data
    assert xls.workbook_stream(memoryview(W.compound(data, "Book"))) == data
    assert xls.workbook_stream(memoryview(W.compound(data, "Other"))) is None


def test_broken_compound_files():
    data = W.compound(bytes(9000))
    with pytest.raises(ValueError, match="no sector"):
        xls.workbook_stream(memoryview(data[:3000]))


def test_strings_that_run_on():
    texts = ["a" * 9000, "", "é☺" * 5000, *(f"text {k}" for k in range(3000)), "x" * 20_000]
    (kind, parts), = [r for r in xls.record_stream(W.begin(5) + W.shared_strings(texts) + W.record(10)) if r[0] == xls.STRINGS]
    assert len(parts) > 5 and list(xls.string_items(parts)) == texts
    # a text that goes on in the other width, and one with runs and an extension
    parts = [bytes(8) + struct.pack("<HB", 4, 0) + b"ab", b"\1" + "☺é".encode("utf-16-le") + struct.pack("<HBHI", 1, 12, 2, 3) + b"z" + bytes(11)]
    assert list(xls.string_items(parts)) == ["ab☺é", "z"]


def got(spark, path, **options):
    return {(r["sheet"], r["row"], r["col"]): (r["kind"], next((r[k] for k in ("i", "f", "s", "b") if r[k] is not None), None)) for r in xls.cells(spark, str(path), **options).collect()}


def test_cells(spark, tmp_path):
    path = str(tmp_path / "a.xls")
    W.write(path, {"One": [(1, 2.5, "é☺", True, "#N/A", None, dt.datetime(2021, 1, 1)), (), ("", -7, 1e10, 3.25)], "Two": [(0.1,)]}, is_1904=True, states={"Two": 2})
    assert got(spark, path) == {
        ("One", 0, 0): ("int", 1), ("One", 0, 1): ("float", 2.5), ("One", 0, 2): ("string", "é☺"), ("One", 0, 3): ("bool", True), ("One", 0, 4): ("error", "#N/A"), ("One", 0, 6): ("datetime", 42735.0),
        ("One", 2, 0): ("string", ""), ("One", 2, 1): ("int", -7), ("One", 2, 2): ("float", 1e10), ("One", 2, 3): ("float", 3.25), ("Two", 0, 0): ("float", 0.1),
    }
    assert [(r["sheet"], r["visible"], r["type"], r["is_1904"]) for r in xls.sheets(spark, path).orderBy("sheet_idx").collect()] == [("One", "visible", "worksheet", True), ("Two", "veryHidden", "worksheet", True)]


def test_formula_results_packed_rows_labels_and_merges(spark, tmp_path):
    formula = lambda row, value: W.record(6, struct.pack("<HHH", row, 0, 0) + value + bytes(8))
    special = lambda kind, value=0: bytes([kind, 0, value, 0, 0, 0, 0xFF, 0xFF])
    own = formula(0, struct.pack("<d", 1.5)) + formula(1, special(0)) + W.record(0x207, W.text("far")) + formula(2, special(1, 1)) + formula(3, special(2, 7)) + formula(4, special(3))
    own += W.begin(0x20) + W.record(0x203, bytes(14)) + W.record(10)  # an embedded chart
    own += W.record(0xBD, struct.pack("<HH", 5, 2) + b"".join(struct.pack("<HI", s, v) for s, v in ((0, 5 << 2 | 2), (1, 44197 << 2 | 2), (0, 1551 << 2 | 3))) + struct.pack("<H", 4))
    own += W.record(0x204, struct.pack("<HHH", 6, 0, 0) + W.text("label ☺")) + W.record(0xFD, struct.pack("<HHHI", 7, 0, 0, 99))
    own += W.record(0xE5, struct.pack("<H8H", 2, 0, 1, 2, 3, 4, 4, 5, 6))
    formats = W.record(0x41E, struct.pack("<H", 170) + W.text("[h]:mm")) + W.record(0xE0, bytes(20)) + W.record(0xE0, struct.pack("<HH", 0, 170) + bytes(16))
    (tmp_path / "f.xls").write_bytes(W.compound(W.workbook([("s", own)], formats)))
    assert {k[1:]: v for k, v in got(spark, tmp_path / "f.xls").items()} == {
        (0, 0): ("float", 1.5), (1, 0): ("string", "far"), (2, 0): ("bool", True), (3, 0): ("error", "#DIV/0!"), (4, 0): ("string", ""), (5, 2): ("int", 5), (5, 3): ("timedelta", 44197.0), (5, 4): ("float", 15.51), (6, 0): ("string", "label ☺"),
    }
    assert sorted(tuple(r)[3:] for r in xls.merges(spark, str(tmp_path / "f.xls")).collect()) == [(0, 2, 1, 3), (4, 5, 4, 6)]


def test_older_texts_and_code_pages(spark, tmp_path):
    label = W.record(0x204, struct.pack("<HHHH", 0, 0, 0, 2) + b"\x8a\xe9")
    (tmp_path / "o.xls").write_bytes(W.compound(W.workbook([("s", label)], W.record(0x42, struct.pack("<H", 1252)), kind=0x500), "Book"))
    assert got(spark, tmp_path / "o.xls") == {("s", 0, 0): ("string", "Šé")}
    assert got(spark, tmp_path / "o.xls", codepage=1251) == {("s", 0, 0): ("string", "Љй")}


def test_protected_and_broken_workbooks(spark, tmp_path):
    (tmp_path / "p.xls").write_bytes(W.compound(W.workbook([("s", b"")], W.record(0x2F, b"\1\0"))))
    assert [(r["format"], r["encrypted"]) for r in auto.detect(spark, str(tmp_path)).collect()] == [("xls", True)]
    with pytest.raises(M.PasswordProtected):
        auto.cells(spark, str(tmp_path))
    with pytest.raises(Exception, match="protected by a password"):
        xls.cells(spark, str(tmp_path)).collect()
    (tmp_path / "p.xls").write_bytes(W.compound(W.begin(5) + struct.pack("<HH", 6, 500)))
    with pytest.raises(Exception, match="a record is cut off"):
        xls.cells(spark, str(tmp_path)).collect()
    assert xls.cells(spark, str(tmp_path), strict=False).count() == 0
