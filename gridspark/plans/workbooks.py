"""Round trips: a driver table is written as a workbook, read by the sources, and compared with its SQL."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import Cell
from ..operators import ranges
from ..operators.rows import header_relation, rows_by_headers
from ..shared import shared_folder
from ..shipping import ship
from ..sources import auto, ods, xls, xlsb, xlsx
from ..testing import ods_writer, xls_writer, xlsb_writer, xlsx_writer

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query_of(queries: dict, sqls: dict):
    """A decorator that registers a query with its SQL."""

    def query(sql: str):
        def add(f):
            queries[f.__name__] = f
            sqls[f.__name__] = sql
            return f

        return add

    return query


query = query_of(QUERIES, ORACLE_SQL)


def folder(spark: SparkSession) -> str:
    """A new folder of files that driver and executors share; Python writes there, so it has to be mounted."""
    path = shared_folder(spark, "workbooks")
    kind, _, rest = path.partition(":")
    if rest and kind != "file":
        raise ValueError(f"workbooks are written as files, and {kind} is no mounted file system")
    path = re.sub("^file:/*", "/", path)
    os.makedirs(path, exist_ok=True)
    return path


#: Rows and bytes (as Arrow columns) of a workbook at most; what is more goes into further workbooks.
ROWS, BYTES = 25_000, 8 << 20


def rows_in_books(batches: Iterator[pa.RecordBatch], most: int = ROWS, size: int = BYTES) -> Iterator[list[tuple]]:
    """The rows of a partition, cut into lists of at most ``most`` rows and about ``size`` bytes; no more than one is held."""
    held, taken = [], 0.0
    for b in batches:
        each = max(1.0, b.nbytes / max(1, b.num_rows))
        at = 0
        while at < b.num_rows:
            own = b.slice(at, max(1, min(most - len(held), int((size - taken) / each))))
            held += zip(*(c.to_pylist() for c in own.columns))
            at, taken = at + own.num_rows, taken + own.num_rows * each
            if len(held) >= most or taken + each > size:
                yield held
                held, taken = [], 0.0
    if held:
        yield held


def files_of(spark: SparkSession, df: DataFrame, name: str, make: Callable[[io.BytesIO, list[tuple]], None], kind: str = "xlsx") -> DataFrame:
    """(path, content) of workbooks that ``make(file, rows)`` writes, stored in the shared folder: as many of each partition's rows
    as their bounds ask for, written one after another.

    Spark writes the table, so nothing of failed attempts is in it, and neither paths nor workbooks come to the driver.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(rows_in_books(batches)):
            made = io.BytesIO()
            make(made, rows)
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{TaskContext.get().partitionId()}-{k}.{kind}"]), pa.array([made.getvalue()])], names=["path", "content"])

    at = shared_folder(spark, name)
    # row groups of a few workbooks, so that readers hold few of them and share a file
    df.mapInArrow(run, "path string, content binary").write.option("parquet.block.row.count.limit", 8).parquet(at)
    return spark.read.schema("path string, content binary").parquet(at)


def written(spark: SparkSession, df: DataFrame, name: str, header: bool = True, writer=xlsx_writer, kind: str = "xlsx", **options) -> DataFrame:
    """Workbooks with one sheet each that together hold df."""
    columns = tuple(df.columns)
    plain = df.select(*(F.col(f.name).cast("timestamp_ntz") if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema))

    def make(file: io.BytesIO, rows: list[tuple]) -> None:
        writer.write(file, {name: chain([columns] if header else [], rows)}, **options)

    return files_of(spark, plain.repartition(spark.sparkContext.defaultParallelism), name, make, kind)


def scanned(spark: SparkSession, paths, df: DataFrame, header_row: int = 0) -> DataFrame:
    """The typed rows of workbooks under df's schema, each by its own header. Every file is opened once."""
    parts = xlsx.opened(spark, paths)
    heads = header_relation(xlsx.cells(spark, parts, last_row=header_row), ["path", "sheet"], header_row)
    return rows_by_headers(xlsx.cells(spark, parts), heads, df.schema, ["path", "sheet"]).drop("path", "sheet")


def _typed(cells: DataFrame, df: DataFrame, header_row: int = 0) -> DataFrame:
    return rows_by_headers(cells, header_relation(cells, ["path", "sheet"], header_row), df.schema, ["path", "sheet"]).drop("path", "sheet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT * FROM nation")
def xlsx_scan_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return scanned(spark, written(spark, df, "nation"), df)


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders")
def xlsx_dates_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice", "o_orderstatus")
    return scanned(spark, written(spark, df, "orders"), df)


@query("SELECT o_orderkey, o_orderdate FROM orders")
def xlsx_dates_1904(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return scanned(spark, written(spark, df, "orders", is_1904=True), df)


@query("SELECT * FROM supplier")
def xlsx_header_row_offset(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    return scanned(spark, written(spark, df, "supplier", first=(4, 3), shared=False), df, header_row=4)


@query("SELECT n_regionkey::VARCHAR AS sheet, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY 1")
def xlsx_sheets_per_region(spark, sf_dir):
    rows: dict[str, list] = {}
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        rows.setdefault(str(r["n_regionkey"]), []).append((r["n_name"],))
    path = f"{folder(spark)}/regions.xlsx"
    xlsx_writer.write(path, rows)
    return xlsx.cells(spark, path).groupBy("sheet").agg(F.count("*").alias("n"), F.min("s").alias("first_name"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def xlsx_table_body(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    columns = df.columns

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        every = [("number", "name", "price"), *rows, ("Total", None, 1.0)]
        xlsx_writer.write(path, {"part": every}, tables={"part": ("Parts", f"A1:C{len(rows) + 2}", columns, 1)})

    paths = files_of(spark, df.repartition(spark.sparkContext.defaultParallelism), "part", make)
    bodies = xlsx.tables(spark, paths).where("name = 'Parts'")
    # the columns of each table are the header of its body
    heads = bodies.select("path", "sheet", (F.col("r0") - 1).alias("header_row"), "c0", F.posexplode("columns").alias("k", "name")).select("path", "sheet", "header_row", (F.col("c0") + F.col("k")).cast("int").alias("col"), "name")
    cells = ranges.in_rectangles(xlsx.cells(spark, paths), bodies.select("path", "sheet", "r0", "c0", "r1", "c1"), ["path", "sheet"])
    return rows_by_headers(cells.drop("r0", "c0", "r1", "c1"), heads, df.schema, ["path", "sheet"]).drop("path", "sheet")


@query("SELECT s_suppkey::INT AS row, s_suppkey // 10 AS rectangle FROM supplier WHERE s_suppkey % 10 < 3")
def xlsx_merge_containment(spark, sf_dir):
    """In every workbook the keys of some tens, in order; the first three of each ten are under a merge, which its first cell names."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism, F.floor(F.col("s_suppkey") / 10))

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        keys = sorted(k for k, in rows)
        merged: dict[int, list[int]] = {}
        for at, k in enumerate(keys, 1):
            if k % 10 < 3:
                merged.setdefault(k // 10, []).append(at)
        xlsx_writer.write(path, {"s": [(k,) for k in keys]}, merges={"s": [f"A{own[0]}:A{own[-1]}" for own in merged.values()]})

    paths = files_of(spark, df, "merged", make)
    cells = ranges.used(xlsx.cells(spark, paths)).select("path", "sheet", "row", "col", "f")
    found = ranges.in_rectangles(cells, xlsx.merges(spark, paths).select("path", "sheet", "r0", "c0", "r1", "c1"), ["path", "sheet"])
    first = cells.select("path", "sheet", F.col("row").alias("r0"), F.col("f").alias("first"))
    return found.join(first, ["path", "sheet", "r0"]).select(F.col("f").cast("int").alias("row"), F.floor(F.col("first") / 10).cast("long").alias("rectangle"))


@query("SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url <> ''")
def xlsx_hyperlinks_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL AND url <> ''").select("page_id", "url")

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        xlsx_writer.write(path, {"links": [(page,) for page, _ in rows]}, links={"links": [(f"A{k}", url) for k, (_, url) in enumerate(rows, 1)]})

    paths = files_of(spark, pages.repartition(spark.sparkContext.defaultParallelism), "links", make)
    links = xlsx.hyperlinks(spark, paths).select("path", "sheet", F.col("r0").cast("int").alias("row"), F.col("target").alias("url"))
    return xlsx.cells(spark, paths).select("path", "sheet", "row", F.col("f").cast("long").alias("page_id")).join(links, ["path", "sheet", "row"]).select("page_id", "url")


@query("SELECT s_suppkey::INT AS row, 'A' || s_suppkey || '*2+$B$1' AS formula FROM supplier WHERE s_suppkey >= 1")
def xlsx_shared_formula(spark, sf_dir):
    """Each key in its row; the first row of a workbook has the formula that the others share."""
    df = table(spark, sf_dir, "supplier").where("s_suppkey >= 1").select("s_suppkey")

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        keys = sorted(k for k, in rows)
        first = {"f": f"A{keys[0]}*2+$B$1", "attrs": f' t="shared" si="0" ref="C{keys[0]}:C{keys[-1]}"', "v": 2 * keys[0]}
        shared = lambda k: {"attrs": ' t="shared" si="0"', "v": 2 * k}
        xlsx_writer.write(path, {"s": [(k - 1, (float(k), None, shared(k) if n else first)) for n, k in enumerate(keys)]}, numbered=True)

    paths = files_of(spark, df.repartition(spark.sparkContext.defaultParallelism, "s_suppkey"), "shared", make)
    return xlsx.cells(spark, paths).where("formula IS NOT NULL").select((F.col("row") + 1).alias("row"), "formula")


_STATES = "CASE r_regionkey % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' ELSE 'veryHidden' END AS visible, 'worksheet' AS type"


@query(f"SELECT r_name AS sheet, r_regionkey::INT AS sheet_idx, {_STATES}, n_name AS name, r_name || '!$A$' || (n_nationkey + 1) AS formula FROM region JOIN nation ON n_regionkey = r_regionkey")
def xlsx_sheets_and_names(spark, sf_dir):
    """A sheet for each region, a name for each nation."""
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name").coalesce(1)  # 25 rows

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        regions = dict(sorted({(k, r) for k, r, _, _ in rows}))
        states = {r: ("visible", "hidden", "veryHidden")[k % 3] for k, r in regions.items() if k % 3}
        xlsx_writer.write(path, {r: [(1,)] for r in regions.values()}, states=states, names={n: f"{r}!$A${k + 1}" for _, r, k, n in rows})

    paths = files_of(spark, df, "names", make)
    named = xlsx.sheets(spark, paths).join(xlsx.defined_names(spark, paths), "path").where("formula LIKE concat(sheet, '!%')")
    return named.select("sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"), "visible", "type", "name", "formula")


@query("SELECT conv_id, turn, unnest(generate_series(0, (length(text) - 1) // 32767))::INT AS part, substring(text, part * 32767 + 1, 32767) AS text FROM conversations WHERE text <> ''")
def xlsx_text_roundtrip(spark, sf_dir):
    """Whole texts, in as many cells as the limit of a cell asks for."""
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 32767).cast("int")))
    df = table(spark, sf_dir, "conversations").where("text <> ''").withColumn("part", parts).select("conv_id", "turn", "part", F.expr("substring(text, part * 32767 + 1, 32767)").alias("text"))
    return scanned(spark, written(spark, df, "conversations"), df)


_LINES = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINES).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines_of(spark, sf_dir)
    return scanned(spark, written(spark, df, "lineitem"), df)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary_from_workbook(spark, sf_dir):
    kept = lineitem(spark, sf_dir).where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def nations_by_region_from_workbook(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return scanned(spark, written(spark, df, "nation"), df).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::INT AS row, s_name || ';' || s_nationkey::VARCHAR AS line FROM supplier")
def csv_lines_from_workbook(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    cells = xlsx.cells(spark, written(spark, df, "supplier", header=False))
    made = ranges.rows(cells, ["path", "sheet"], Cell().display())
    return made.select(F.col("values")[0].cast("int").alias("row"), F.concat_ws(";", F.col("values")[1], F.col("values")[2]).alias("line"))


def _ods(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    parts, by = ods.opened(spark, written(spark, df, name, writer=ods_writer, kind="ods")), ["path", "sheet"]
    heads = header_relation(ods.cells(spark, parts, last_row=0), by, 0)
    return rows_by_headers(ods.cells(spark, parts), heads, df.schema, by).drop(*by)


@query("SELECT * FROM nation")
def ods_scan_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return _ods(spark, df, "nation")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def ods_dates_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice")
    return _ods(spark, df, "orders")


@query("SELECT format, r_regionkey::BIGINT AS key, r_name AS name FROM region CROSS JOIN (VALUES ('xlsx'), ('ods'), ('xlsb'), ('xls')) t(format)")
def auto_multi_format_union(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]  # 5 rows
    at = folder(spark)
    xlsx_writer.write(f"{at}/a.xlsx", {"r": rows})
    ods_writer.write(f"{at}/b.ods", {"r": rows})
    xlsb_writer.write(f"{at}/c.xlsb", {"r": rows})
    xls_writer.write(f"{at}/d.xls", {"r": rows})
    own = auto.cells(spark, at).withColumn("format", F.regexp_extract("path", r"([a-z]+)$", 1))
    return own.groupBy("format", "row").agg(F.max(F.when(F.col("col") == 0, F.coalesce(F.col("f"), F.col("i").cast("double")))).cast("long").alias("key"), F.max(F.when(F.col("col") == 1, F.col("s"))).alias("name")).drop("row")


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN '#N/A' WHEN 1 THEN '#DIV/0!' ELSE '#REF!' END AS error, count(*) AS errors FROM supplier WHERE s_suppkey % 5 < 3 GROUP BY 1")
def error_report_by_workbook(spark, sf_dir):
    """Errors in the cells of many workbooks, counted by workbook and then by kind."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        xlsx_writer.write(path, {"e": [(("#N/A", "#DIV/0!", "#REF!")[k % 3] if k % 5 < 3 else "fine", name) for k, name in rows]})

    bad = xlsx.cells(spark, files_of(spark, df.repartition(spark.sparkContext.defaultParallelism), "errors", make)).where("kind = 'error'").groupBy("path", F.col("s").alias("error")).agg(F.count("*").alias("errors"))
    return bad.groupBy("error").agg(F.sum("errors").alias("errors"))


def _xlsb(spark: SparkSession, df: DataFrame, name: str, **options) -> DataFrame:
    books, by = written(spark, df, name, writer=xlsb_writer, kind="xlsb", **options), ["path", "sheet"]
    heads = header_relation(xlsb.cells(spark, books, last_row=0), by, 0)
    return rows_by_headers(xlsb.cells(spark, books), heads, df.schema, by).drop(*by)


@query("SELECT * FROM nation")
def xlsb_scan_nation(spark, sf_dir):
    return _xlsb(spark, table(spark, sf_dir, "nation"), "nation")


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def xlsb_dates_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice", "o_orderpriority")
    return _xlsb(spark, df, "orders", is_1904=True)


def _xls(spark: SparkSession, df: DataFrame, name: str, **options) -> DataFrame:
    """A sheet of this format has 65,536 rows at most; workbooks are shorter."""
    return _typed(xls.cells(spark, written(spark, df, name, writer=xls_writer, kind="xls", **options)), df)


@query("SELECT * FROM nation")
def xls_scan_nation(spark, sf_dir):
    return _xls(spark, table(spark, sf_dir, "nation"), "nation")


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def xls_dates_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice", "o_orderpriority")
    return _xls(spark, df, "orders", is_1904=True)


@query(f"SELECT r_name AS sheet, r_regionkey::INT AS sheet_idx, {_STATES} FROM region")
def xls_sheets(spark, sf_dir):
    df = table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1)  # 5 rows

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        xls_writer.write(path, {name: [(k,)] for k, name in sorted(rows)}, states={name: k % 3 for k, name in rows})

    return xls.sheets(spark, files_of(spark, df, "states", make, "xls")).select("sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"), "visible", "type")


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def _package(path: str, sheet: str, book: str = "xl/workbook.xml", part: str = "worksheets/sheet1.xml", kind: str = "http://schemas.openxmlformats.org/officeDocument/2006/relationships") -> str:
    """A workbook of the fewest parts: its document root, relationships and one sheet."""
    base, name = book.rsplit("/", 1)
    link = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{}/{}" Target="{}"/></Relationships>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", link.format(kind, "officeDocument", book))
        z.writestr(book, f'<workbook xmlns:r="{kind}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr(f"{base}/_rels/{name}.rels", link.format(kind, "worksheet", part))
        z.writestr(f"{base}/{part}", sheet)
    return path


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) AS k FROM supplier)
SELECT s_suppkey // 100 AS book, (k + CASE WHEN k > 10 THEN 100 ELSE 0 END)::INT AS row, c AS col, CASE c WHEN 2 THEN s_suppkey WHEN 3 THEN s_nationkey ELSE s_suppkey % 7 END::BIGINT AS v FROM n, (VALUES (2), (3), (7)) t(c)""")
def xlsx_absent_references(spark, sf_dir):
    """Rows and cells without references go on from the ones before: the first, the eleventh row and two columns are named. A workbook for each hundred keys."""
    hundred = F.floor(F.col("s_suppkey") / 100).cast("long")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").groupBy(hundred.alias("book")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_nationkey"))).alias("rows"))
    ship(spark)
    at = folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book, rows in zip(b.column("book").to_pylist(), b.column("rows").to_pylist()):
                made, n = [], 0
                for k, r in enumerate(rows, 1):
                    n = {1: 2, 11: n + 101}.get(k, n + 1)
                    named = f' r="{n}"' if k in (1, 11) else ""
                    made.append(f'<row{named}><c r="C{n}"><v>{r["s_suppkey"]}</v></c><c><v>{r["s_nationkey"]}</v></c><c r="H{n}"><v>{r["s_suppkey"] % 7}</v></c></row>')
                path = _package(f"{at}/absent-{TaskContext.get().taskAttemptId()}-{book}.xlsx", _SHEET.format("".join(made)))
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    paths = [r["path"] for r in df.mapInArrow(run, "path string").collect()]  # a row for each workbook
    return xlsx.cells(spark, paths).select(F.regexp_extract("path", r"-(\d+)\.xlsx$", 1).cast("long").alias("book"), "row", "col", F.col("f").cast("long").alias("v"))


@query("SELECT r_regionkey::BIGINT AS v, 's' AS sheet FROM region")
def xlsx_strict_package(spark, sf_dir):
    """Parts under names of their own, found by the strict relationships of the package."""
    rows = "".join(f"<row><c><v>{r[0]}</v></c></row>" for r in table(spark, sf_dir, "region").select("r_regionkey").collect())
    path = _package(f"{folder(spark)}/strict.xlsx", _SHEET.format(rows), "main/book.xml", "data/first.xml", "http://purl.oclc.org/ooxml/officeDocument/relationships")
    return xlsx.cells(spark, path).select(F.col("f").cast("long").alias("v"), "sheet")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def xlsx_prefixed_sheet(spark, sf_dir):
    """Sheets whose elements have a prefix; they are cut into chunks like any other."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return scanned(spark, written(spark, df, "orders", prefix="x"), df)


@query("SELECT l_orderkey % 16 AS book, 0 AS r0, 0 AS c0, count(*)::INT - 1 AS r1, 1 AS c1 FROM lineitem GROUP BY 1")
def xlsx_declared_dimension(spark, sf_dir):
    """The rectangles that sheets declare; no more than the first chunk of a sheet is inflated. A book's rows lie in as many sheets
    of its name as workbooks take, and their rectangles stand one below the other."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("book"), "l_orderkey", "l_quantity").repartition(spark.sparkContext.defaultParallelism)

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        books: dict[int, list] = {}
        for book, key, quantity in rows:
            books.setdefault(book, []).append((key, float(quantity)))
        xlsx_writer.write(path, {str(b): own for b, own in books.items()}, dimensions={str(b): f"A1:B{len(own)}" for b, own in books.items()})

    found = xlsx.dimensions(spark, files_of(spark, df, "lines", make))
    rows = F.sum(F.col("r1") - F.col("r0") + 1) - 1
    return found.groupBy(F.col("sheet").cast("long").alias("book")).agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), (F.min("r0") + rows).cast("int").alias("r1"), F.max("c1").alias("c1"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def rows_by_own_headers(spark, sf_dir):
    """Workbooks with their columns in two orders and headers in different rows, read at once."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")

    def make(path: io.BytesIO, rows: list[tuple]) -> None:
        turned = rows[0][0] % 2
        own = [r[::-1] for r in [("o_orderkey", "o_orderstatus", " o_totalprice "), *rows]] if turned else [("o_orderkey", "o_orderstatus", "o_totalprice"), *rows]
        xlsx_writer.write(path, {"orders": own}, first=(3, 2) if turned else (0, 0))

    paths = files_of(spark, df.repartition(spark.sparkContext.defaultParallelism), "orders", make)
    # ranges begin with their first row that has cells
    heads = header_relation(xlsx.cells(spark, paths, last_row=10), ["path", "sheet"])
    return rows_by_headers(xlsx.cells(spark, paths), heads, df.schema, ["path", "sheet"]).drop("path", "sheet")


@query("SELECT value, count(*) AS n, min(o_orderkey) AS least FROM (SELECT o_orderkey, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders) GROUP BY 1")
def xlsx_dictionary_scan(spark, sf_dir):
    """Cells grouped by the number of their shared string; texts are fetched for the groups."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    parts = xlsx.opened(spark, written(spark, df, "orders", header=False))
    cells = xlsx.coded_cells(spark, parts)
    keys = cells.where("col = 0").select("path", "row", F.col("f").cast("long").alias("key"))
    coded = cells.where("string_index IS NOT NULL").select("path", "row", "string_index").join(keys, ["path", "row"])
    groups = coded.groupBy("path", "string_index").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    texts = xlsx.with_strings(groups, xlsx.shared_strings(spark, parts))
    return texts.groupBy(F.col("s").alias("value")).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
