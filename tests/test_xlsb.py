"""xlsb: numbers out of bits, records, and a workbook with every kind of cell."""

import datetime as dt
import math
import struct

import pytest
from pyspark.sql import functions as F

from gridspark.functions import binary as B
from gridspark.sources import xlsb
from gridspark.testing import xlsb_writer


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, math.pi, float("inf"), float("-inf"), 1 / 3])
def test_double(spark, x):
    got = spark.createDataFrame([(struct.pack("<Id", 7, x),)], "d binary").select(B.double(F.col("d"), 4).alias("v")).first()["v"]
    assert got == x


@pytest.mark.parametrize(("rk", "whole", "number"), [(5 << 2 | 2, 5, 5.0), ((-5 << 2 | 2) & 0xFFFFFFFF, -5, -5.0), (1500 << 2 | 3, 15, 15.0), (1551 << 2 | 3, None, 15.51), (0x3FF00000, None, 1.0), (0x3FF00001, None, 0.01)])
def test_packed_numbers(spark, rk, whole, number):
    r = spark.range(1).select(B.rk_integer(F.lit(rk).cast("long")).alias("i"), B.rk_double(F.lit(rk).cast("long")).alias("f")).first()
    assert (r["i"], r["f"]) == (whole, number)


def test_records_end_where_data_do():
    data = xlsb_writer.record(19, b"a" * 200) + xlsb_writer.record(617) + b"\x93\x01\x7f"
    assert [(k, len(b)) for k, b in xlsb.record_stream(memoryview(data))] == [(19, 200), (617, 0)]


def test_cells(spark, tmp_path):
    path = str(tmp_path / "a.xlsb")
    xlsb_writer.write(path, {"One": [(1, 2.5, "é☺", True, "#N/A", None, dt.datetime(2021, 1, 1)), (), ("", -7, 1e10, 3.25)], "Two": [(0.1,)]}, is_1904=True)
    got = {(r["sheet"], r["row"], r["col"]): (r["kind"], next((r[k] for k in ("i", "f", "s", "b") if r[k] is not None), None)) for r in xlsb.cells(spark, path).collect()}
    assert got == {
        ("One", 0, 0): ("int", 1), ("One", 0, 1): ("float", 2.5), ("One", 0, 2): ("string", "é☺"), ("One", 0, 3): ("bool", True), ("One", 0, 4): ("error", "#N/A"), ("One", 0, 6): ("datetime", 42735.0),
        ("One", 2, 0): ("string", ""), ("One", 2, 1): ("int", -7), ("One", 2, 2): ("float", 1e10), ("One", 2, 3): ("float", 3.25), ("Two", 0, 0): ("float", 0.1),
    }
    assert [r["is_1904"] for r in xlsb.sheets(spark, path).collect()] == [True, True]


def test_cells_are_not_broadcast(spark, tmp_path):
    """Packages are compressed: a relation of cells that looks small by its files is not sent through the driver."""
    path = str(tmp_path / "a.xlsb")
    xlsb_writer.write(path, {"s": [(1, "a")]})
    cells = xlsb.cells(spark, path)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    first = plan.index("ShuffledHashJoin")  # cells meet all small indexes of their workbook there
    assert "BuildLeft" not in plan[:first] and cells.count() == 2
