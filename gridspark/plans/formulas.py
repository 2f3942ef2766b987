"""Formula texts and defined names of binary workbooks and of all formats, over the driver's tables."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..shipping import ship
from ..sources import auto, xls, xlsb
from ..testing import ods_writer, xls_writer, xlsb_writer, xlsx_writer
from ..testing.token_writer import Formula, compiled
from .workbooks import query_of, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = query_of(QUERIES, ORACLE_SQL)


def _values(column: pa.Array) -> list:
    """A column as Python values, numbers and texts at once."""
    kind = column.type
    if pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_boolean(kind) or kind in (pa.float32(), pa.float64()))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def blobs(df: DataFrame, name: str, make: Callable[[list[tuple], io.BytesIO], None]) -> DataFrame:
    """(path, content), stored in the shared folder: a workbook of each partition's rows, written by ``make``.

    Spark writes the table, so that the folder may be one that only Spark reaches, and a task that runs again leaves nothing double.
    """
    spark = df.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(*map(_values, b.columns))]
        if rows:
            made = io.BytesIO()
            make(rows, made)
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{TaskContext.get().partitionId()}"]), pa.array([made.getvalue()])], names=["path", "content"])

    at = shared_folder(spark, name)
    df.mapInArrow(run, "path string, content binary").write.parquet(at)
    return spark.read.schema("path string, content binary").parquet(at)


def parts_of(spark: SparkSession, df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt out over as many partitions as workbooks of so many rows take, by hash of a row."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.count() // rows + 1), *df.columns)


def _formula_rows(rows: list[tuple], dialect: str) -> list[tuple]:
    """A number and a formula over the columns of an order, with a reference, constants, a text, calls, another sheet and a name."""
    out = []
    # what is the same in many rows is compiled once
    rounded, name = (compiled(x, dialect) for x in (("call", 27, [("*", ("ref3d", 1, 4, 2), 0.5), 2]), ("name", 1)))
    noted = {status: compiled(("&", status, ("sum", ("area", 0, 0, 9, 1))), dialect) for status in {r[2] for r in rows}}
    for key, customer, status, value in rows:
        at = ("ref", key % 60_000, customer % 200, True, True)
        test = (">=", at, key % 65_536)
        x = ("call_n", 1, [test, rounded, noted[status]])
        out.append((float(key), Formula(compiled(("+", ("-", ("()", x)), name), dialect), value)))
    return out


_LETTERS = "CASE WHEN o_custkey % 200 < 26 THEN chr((65 + o_custkey % 200)::INT) ELSE chr((64 + o_custkey % 200 // 26)::INT) || chr((65 + o_custkey % 200 % 26)::INT) END"
_EXPECTED = f"""SELECT o_orderkey, o_totalprice AS value, '-(IF(' || {_LETTERS} || (o_orderkey % 60000 + 1) || '>=' || (o_orderkey % 65536)
 || ',ROUND(rates!$C$5*0.5,2),"' || o_orderstatus || '"&SUM($A$1:$B$10)))+Rate' AS formula FROM orders"""


def _formula_cells(spark: SparkSession, sf_dir: str, writer, dialect: str, cells: Callable) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")

    def make(rows: list[tuple], out: io.BytesIO) -> None:
        rate = compiled(("ref3d", 1, 0, 0), dialect)
        writer.write(out, {"orders": _formula_rows(rows, dialect), "rates": [(0.5,)]}, names={"Rate": rate}, external=[0, 1])

    own = cells(spark, blobs(parts_of(spark, df), "formulas", make)).where("sheet = 'orders'")
    pair = own.groupBy("path", "row").agg(F.max(F.when(F.col("col") == 0, F.col("f"))).alias("key"), F.max(F.when(F.col("col") == 1, F.struct("f", "formula"))).alias("x"))
    return pair.select(F.col("key").cast("long").alias("o_orderkey"), F.col("x.f").alias("value"), F.col("x.formula").alias("formula"))


@query(_EXPECTED)
def xlsb_formula_text(spark, sf_dir):
    return _formula_cells(spark, sf_dir, xlsb_writer, "xlsb", xlsb.cells)


@query(_EXPECTED)
def xls_formula_text(spark, sf_dir):
    return _formula_cells(spark, sf_dir, xls_writer, "biff8", xls.cells)


@query("""SELECT f.format, n_name AS name, CASE f.format WHEN 'ods' THEN '$nations.$B$' || (n_nationkey + 1) || ':.$C$' || (n_nationkey + 1)
  ELSE 'nations!$B$' || (n_nationkey + 1) || ':$C$' || (n_nationkey + 1) END AS formula FROM nation, (VALUES ('xlsx'), ('xlsb'), ('xls'), ('ods')) f(format)""")
def names_all_formats(spark, sf_dir):
    """A name for each nation, of the two cells beside it, in a workbook of each format."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1)  # 25 rows

    def make(kind: str) -> Callable:
        def write(rows: list[tuple], out: io.BytesIO) -> None:
            cells = {"nations": [(name, 1.0, 2.0) for _, name in rows]}
            if kind == "ods":
                ods_writer.write(out, cells, names={n: f"$nations.$B${k + 1}:.$C${k + 1}" for k, n in rows})
            elif kind == "xlsx":
                xlsx_writer.write(out, cells, names={n: f"nations!$B${k + 1}:$C${k + 1}" for k, n in rows})
            else:
                dialect, writer = ("xlsb", xlsb_writer) if kind == "xlsb" else ("biff8", xls_writer)
                writer.write(out, cells, names={n: compiled(("area3d", 0, k, 1, k, 2), dialect) for k, n in rows}, external=[0])

        return write

    books = None
    for kind in ("xlsx", "xlsb", "xls", "ods"):
        own = blobs(df, f"names.{kind}", make(kind)).withColumn("path", F.lit(f"names.{kind}"))
        books = own if books is None else books.unionByName(own)
    return auto.defined_names(spark, books).select(F.regexp_extract("path", r"([a-z]+)$", 1).alias("format"), "name", "formula")


@query("""SELECT 'sheet ' || r_regionkey AS sheet, r_regionkey::INT AS sheet_idx, f.format, CASE WHEN r_regionkey % 2 = 1 THEN 'hidden' ELSE 'visible' END AS visible, 'worksheet' AS type
FROM region, (VALUES ('xls'), ('ods'), ('xlsx'), ('xlsb')) f(format)""")
def sheets_all_formats(spark, sf_dir):
    """Sheets made of the regions; every second one is hidden."""
    df = table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1)  # 5 rows

    def make(kind: str) -> Callable:
        def write(rows: list[tuple], out: io.BytesIO) -> None:
            cells = {f"sheet {k}": [(name,)] for k, name in sorted(rows)}
            odd = [f"sheet {k}" for k, _ in rows if k % 2]
            if kind == "ods":
                ods_writer.write(out, cells, hidden=tuple(odd))
            elif kind == "xlsx":
                xlsx_writer.write(out, cells, states=dict.fromkeys(odd, "hidden"))
            else:
                (xls_writer if kind == "xls" else xlsb_writer).write(out, cells, states=dict.fromkeys(odd, 1))

        return write

    books = None
    for kind in ("xlsx", "xlsb", "xls", "ods"):
        own = blobs(df, f"sheets.{kind}", make(kind)).withColumn("path", F.lit(f"sheets.{kind}"))
        books = own if books is None else books.unionByName(own)
    return auto.sheets(spark, books).select("sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"), F.regexp_extract("path", r"([a-z]+)$", 1).alias("format"), "visible", "type")


@query("SELECT r_regionkey::BIGINT AS key, c_custkey, c_mktsegment AS segment FROM customer, region WHERE c_nationkey % 5 = r_regionkey")
def cells_of_blobs(spark, sf_dir):
    """Workbooks in a binary column, not files: a sheet of each workbook is named by the region of its customers."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")

    def make(rows: list[tuple], out: io.BytesIO) -> None:
        cells: dict[str, list] = {}
        for key, nation, segment in rows:
            cells.setdefault(str(nation % 5), []).append((float(key), segment))
        xlsb_writer.write(out, cells)

    own = auto.cells(spark, blobs(parts_of(spark, df), "customers.xlsb", make).withColumn("path", F.concat("path", F.lit(".xlsb"))))
    rows = own.groupBy("path", "sheet", "row").agg(F.max(F.when(F.col("col") == 0, F.coalesce(F.col("f"), F.col("i").cast("double")))).cast("long").alias("c_custkey"), F.max(F.when(F.col("col") == 1, F.col("s"))).alias("segment"))
    return rows.select(F.col("sheet").cast("long").alias("key"), "c_custkey", "segment")
