"""Functions on cells, references and formats: vectors, and every query against its SQL."""

import datetime as dt
import math
import os
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark import model as M
from gridspark.functions import formats, refs
from gridspark.functions.cells import Cell, float_text, serial_datetime, ymd_hms_milli
from gridspark.operators import ranges
from gridspark.operators.rows import header_names, infer_types, select_headers, target, typed_rows
from gridspark.plans import catalogue

SF = "/root/testdata/sf0.001"
CELL = "kind string, i bigint, f double, s string, b boolean, is_1904 boolean"
TABLES = tuple(n.removesuffix(".parquet") for n in os.listdir(SF)) if os.path.isdir(SF) else ()


def one(spark, column, cell):
    return spark.createDataFrame([cell], CELL).select(column.alias("v")).first()["v"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def int_(i):
    return ("int", i, None, None, None, False)


def float_(f):
    return ("float", None, f, None, None, False)


def text(s, kind="string"):
    return (kind, None, None, s, None, False)


@pytest.mark.parametrize(("f", "want"), [(1.0, "1"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (-2.5, "-2.5"), (1.5e-5, "0.000015"), (12345678.25, "12345678.25"), (0.0, "0"), (float("nan"), "NaN"), (float("-inf"), "-inf")])
def test_float_text(spark, f, want):
    assert one(spark, Cell().as_string(), float_(f)) == want


@pytest.mark.parametrize(("cell", "want"), [(float_(1e30), (1 << 63) - 1), (float_(-1e30), -(1 << 63)), (float_(float("nan")), 0), (float_(-1.9), -1), (text("12"), 12), (text("1.5"), None), (text(" 1"), None), (text("99999999999999999999"), None), (("bool", None, None, None, True, False), 1), (text("#N/A", "error"), None)])
def test_as_i64(spark, cell, want):
    assert one(spark, Cell().as_i64(), cell) == want


@pytest.mark.parametrize(("cell", "want"), [(text("1e3"), 1000.0), (text("1d"), None), (text(" 1 "), None), (text(""), None), (int_(2), 2.0)])
def test_as_f64(spark, cell, want):
    assert one(spark, Cell().as_f64(), cell) == want


@pytest.mark.parametrize(("cell", "want"), [(text("TRUE"), True), (text("tRUE"), None), (M.EMPTY, False), (float_(0.0), False), (text("2020-01-01", "datetime_iso"), True)])
def test_to_bool(spark, cell, want):
    cell = ("empty", None, None, None, None, False) if cell == M.EMPTY else cell
    assert one(spark, Cell().to_bool(), cell) is want


@pytest.mark.parametrize(("serial", "old", "want"), [(44197.0, False, dt.datetime(2021, 1, 1)), (42735.0, True, dt.datetime(2021, 1, 1)), (59.0, False, dt.datetime(1900, 2, 28)), (60.0, False, dt.datetime(1900, 2, 28)), (61.0, False, dt.datetime(1900, 3, 1)), (0.5, False, dt.datetime(1899, 12, 31, 12)), (1e12, False, None)])
def test_serial_datetime(spark, serial, old, want):
    assert value(spark, serial_datetime(F.lit(serial), F.lit(old))) == want


@pytest.mark.parametrize(("serial", "old", "want"), [(0.0, False, (1899, 12, 31)), (59.0, False, (1900, 2, 28)), (60.0, False, (1900, 2, 29)), (61.0, False, (1900, 3, 1)), (0.0, True, (1904, 1, 1)), (44197.0, False, (2021, 1, 1))])
def test_ymd(spark, serial, old, want):
    assert tuple(value(spark, ymd_hms_milli(F.lit(serial), F.lit(old))))[:3] == want


def test_milliseconds_carry(spark):
    assert tuple(value(spark, ymd_hms_milli(F.lit(100 + 0.999999999), F.lit(False)))) == (1900, 4, 10, 0, 0, 0, 0)


def test_iso(spark):
    assert one(spark, Cell().as_datetime(), text("2021-01-01", "datetime_iso")) is None
    assert one(spark, Cell().as_date(), text("2021-01-01", "datetime_iso")) == dt.date(2021, 1, 1)
    assert one(spark, Cell().as_datetime(), text("2019-03-07T08:09:11", "datetime_iso")) == dt.datetime(2019, 3, 7, 8, 9, 11)
    assert one(spark, Cell().as_time(), text("PT3H4M5.678901S", "duration_iso")) == "03:04:05.678901"
    assert one(spark, Cell().as_time(), text("07:05:09", "datetime_iso")) == "07:05:09.000000"
    assert one(spark, Cell().as_duration_ms(), text("PT3H4M5.678901S", "duration_iso")) == 11_045_678
    assert one(spark, Cell().as_duration_ms(), ("timedelta", None, 2.25 + 1.5 / 86400, None, None, False)) == 194_401_500


def test_typed_equality(spark):
    assert one(spark, Cell().equals(1), int_(1)) and not one(spark, Cell().equals(1.0), int_(1))
    assert one(spark, Cell().equals("a"), text("a")) and not one(spark, Cell().equals(True), text("a"))


#: Pieces of number formats, and what each of them shows.
PIECES = {
    "other": ["0", "#,##0.00", "??/??", "%", "-", "( )", '"dmyhs"', '"[h]"', "\\d", "_m", "*s", "[Red]", "[>=100]", "[$USD-409]"],
    "datetime": ["yyyy", "Y", "mmm", "M", "dd", "D", "hh", "H", "ss", "S", "AM/PM", "a/p"],
    "timedelta": ["[h]", "[HH]", "[m]", "[mm]", "[s]", "[SSS]"],
}


def test_formats(spark):
    """The first piece of the first section that shows a date or an elapsed time decides."""
    rng, rows = random.Random(12), [("", "other")]
    for _ in range(600):
        kinds = [rng.choice(["other", "other", "other", "datetime", "timedelta"]) for _ in range(rng.randrange(1, 6))]
        end = rng.randrange(len(kinds) + 2)  # a section ends behind some piece, or none does
        code = "".join(rng.choice(PIECES[k]) + (";" if n + 1 == end else "") for n, k in enumerate(kinds))
        shown = [k for k in (kinds[:end] if 0 < end <= len(kinds) else kinds) if k != "other"]
        rows.append((code, shown[0] if shown else "other"))
    df = spark.createDataFrame(rows, "code string, want string").select("code", "want", formats.custom_class(F.col("code")).alias("got"))
    assert [r for r in df.collect() if r["want"] != r["got"]] == []


@pytest.mark.parametrize(("n", "name"), [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (16383, "XFD"), (16384, None)])
def test_columns(spark, n, name):
    assert value(spark, refs.column_name(F.lit(n))) == name
    if name:
        assert value(spark, refs.column_index(F.lit(name.lower()))) == n


def test_references(spark):
    assert value(spark, refs.a1_row(F.lit("b12"))) == 11 and value(spark, refs.a1_col(F.lit("b12"))) == 1
    assert value(spark, refs.a1_row(F.lit("B0"))) is None and value(spark, refs.a1_row(F.lit("B"))) is None
    assert tuple(value(spark, refs.dimension(F.lit("A1:C9")))) == (0, 0, 8, 2) and tuple(value(spark, refs.dimension(F.lit("B2")))) == (1, 1, 1, 1)
    assert value(spark, refs.dimension(F.lit("A1:B2:C3"))) is None


@pytest.mark.parametrize(
    ("formula", "rows", "cols", "want"),
    [("A1*2", 2, 0, "A3*2"), ("$A$1+A$1+$A1", 1, 1, "$A$1+B$1+$A2"), ("SUM(E:F)", 0, 1, "SUM(F:G)"), ("SUM(5:6)", 2, 3, "SUM(7:8)"), ("LOG10(A1)", 1, 0, "LOG10(A2)"), ('"A1"&A1', 1, 0, '"A1"&A2'), ("A1", -1, 0, "A1"), ("XFD1", 0, 1, "XFD1"), ("A1:B2", 1, 1, "B2:C3"), ("E+1", 1, 1, "E+1"), ("Sheet2!A1", 1, 0, "Sheet2!A2")],
)
def test_expand_formula(spark, formula, rows, cols, want):
    assert value(spark, refs.expand_formula(F.lit(formula), F.lit(rows), F.lit(cols))) == want


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "row int, col int, " + CELL)


def test_ranges(spark):
    cells = cells_of(spark, [(2, 1, *int_(1)), (4, 3, *text("x")), (2, 1, *int_(5))])
    assert tuple(ranges.bounds(cells, []).first()) == (2, 1, 4, 3)
    last = ranges.last_wins(cells.withColumn("seq", F.monotonically_increasing_id()), [], "seq")
    assert last.where("row = 2").first()["i"] == 5
    assert ranges.dense(last, []).count() == 9 and ranges.dense(last, []).where("kind = 'empty'").count() == 7
    assert ranges.bounds(cells.limit(0), []).first()["r0"] is None
    padded = ranges.header_row(last, 1, [])
    assert ranges.bounds(padded, []).first()["r0"] == 1
    with pytest.raises(Exception, match="cell limit"):
        ranges.dense(cells, [], most=4).count()


def test_typed_rows(spark):
    from pyspark.sql.types import StructType

    cells = cells_of(spark, [(0, 0, *text(" id ")), (0, 1, *text("v")), (1, 0, *int_(1)), (1, 1, *float_(2.5)), (2, 0, *int_(2)), (2, 1, *text("N/A")), (3, 0, *int_(3))])
    schema = StructType.fromDDL("id bigint, v double")
    names = header_names(cells)
    got = sorted(tuple(r) for r in typed_rows(cells, schema, names, 1).collect())
    assert got == [(1, 2.5), (2, None), (3, None)]
    with pytest.raises(Exception, match="no double"):
        typed_rows(cells, schema, names, 1, strict=True).collect()
    with pytest.raises(M.HeaderNotFound):
        typed_rows(cells, StructType.fromDDL("other bigint"), names, 1)
    assert infer_types(cells.where("row > 0")) == {0: "bigint", 1: "string"}
    with pytest.raises(M.HeaderNotFound):
        select_headers(cells, ["none"])
    assert one(spark, target(Cell(), "bigint"), ("bool", None, None, None, True, False)) is None


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) if abs(v) < 1e6 else float(f"{v:.12g}")
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = catalogue.QUERIES[name](spark, SF), con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(repr([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == sorted(repr([_plain(r[k]) for k in order]) for r in want.fetchall())


def test_float_text_is_the_shortest(spark):
    rng = random.Random(3)
    values = [2.18e18 + 256, 2.0e-3, 0.1 + 0.2, 1e23, 9007199254740993.0, 123.456, 5e-324, 1.7976931348623157e308, *(rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 25) for _ in range(2000))]
    rows = spark.createDataFrame([(v,) for v in values], "f double").select("f", float_text(F.col("f")).alias("t")).collect()
    for r in rows:
        assert Decimal(r["t"]) == Decimal(repr(r["f"])) and "E" not in r["t"].upper(), (r["f"], r["t"])
