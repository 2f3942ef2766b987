"""OpenDocument spreadsheets as the cell relation.

All sheets lie in one member. The inflating helper cuts it behind row ends and says of each chunk in which table and behind how
many of its rows (repeats counted) it begins, so that chunks are dealt out and parsed by themselves. Rows whose cells all have
the usual form are taken apart by a helper, the others by SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.refs import let
from ..model import CELLS, MAX_COLUMNS, MAX_ROWS
from ..shipping import ship
from .parts import Tables, attribute, inflate, opened, unescape

_CONTENT = r"content\.xml"
_PIECE = r"(?s)<table:table(?:\s[^>]*)?>|<table:table-row(?:\s[^>]*?)?/>|<table:table-row(?:\s[^>]*)?>.*?</table:table-row>"
_CELL = r"(?s)<table:(?:covered-)?table-cell(?:\s[^>]*?)?/>|<table:(?:covered-)?table-cell(?:\s[^>]*)?>.*?</table:(?:covered-)?table-cell>"


def _pieces(spark: SparkSession, paths) -> DataFrame:
    """(path, chunk, at, e): table starts and rows, in document order."""
    got = inflate(spark, paths, _CONTENT, "</table:table-row>")
    return got.select("path", "chunk", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))).alias("at", "e"))


def _repeat(element: Column, name: str) -> Column:
    return F.coalesce(attribute(element, name).try_cast("int"), F.lit(1))


#: A cell of the usual form: its type and value, if any, and one paragraph without elements, if any.
_PLAIN = re.compile(r'<table:table-cell(?: table:style-name="[^"<>]*")?(?: office:value-type="([a-z]*)"(?: office:((?:date-|time-|boolean-|string-)?value)="([^"<>]*)")?(?: calcext:value-type="[^"<>]*")?)?(?:/>|>(?:<text:p>([^<]*)</text:p>)?</table:table-cell>)')
_SPLIT = "path string, sheet_idx int, sheet string, row int, n int, scol int, st string, sname string, sv string, sp string, e string"


def _split(last_row: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of rows that have only usual ones, as columns; of other rows their text. None behind ``last_row``."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 5]
    names = [c.split()[0] for c in _SPLIT.split(", ")]

    def batch(path: str, tables: list[tuple], at: list, rows: list, times: list, cols: list | None, cells: list[tuple] | None, others: list | None) -> pa.RecordBatch:
        n, at = len(rows), pa.array(at, pa.int32())
        own = [pa.array([path] * n, kinds[0]), *(pa.array([t[k] for t in tables], kinds[k + 1]).take(at) for k in (0, 1)), pa.array(rows, kinds[3]), pa.array(times, kinds[4])]
        own += [pa.array(cols, kinds[5]), *(pa.array(x, kinds[6]) for x in zip(*cells))] if cells else [pa.nulls(n, k) for k in kinds[5:10]]
        return pa.RecordBatch.from_arrays([*own, pa.array(others, kinds[10]) if others else pa.nulls(n, kinds[10])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index, sheet, line, text in (tuple(x.as_py() for x in own) for own in zip(*(b.column(c) for c in ("path", "sheet_idx", "sheet", "line", "text")))):  # one text at a time
                tables, place = [], Tables(index, sheet, line or 0)
                at, rows, times, cols, cells = [], [], [], [], []
                at_others, rows_others, times_others, others = [], [], [], []
                for n, m in place.rows(text):
                    if m[2] or (last_row is not None and place.row > last_row):
                        continue
                    if not tables or tables[-1][0] != place.index:
                        tables.append((place.index, place.sheet))
                    body = m[4]
                    found = _PLAIN.findall(body)
                    if (k := len(found)) == body.count("<table:table-cell") and "<table:covered-" not in body:
                        at += [len(tables) - 1] * k
                        rows += [place.row] * k
                        times += [n] * k
                        cols += range(k)
                        cells += found
                    else:
                        at_others.append(len(tables) - 1)
                        rows_others.append(place.row)
                        times_others.append(n)
                        others.append(m[0])
                if cells:
                    yield batch(path, tables, at, rows, times, cols, cells, None)
                if others:
                    yield batch(path, tables, at_others, rows_others, times_others, None, None, others)

    return run


def sheets(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet_idx, sheet, type, visible, is_1904) in document order; a sheet is hidden where its style says so."""
    starts = _pieces(spark, paths).where(F.col("e").rlike("^<table:table[\\s>]")).select("path", "chunk", "at", attribute(F.col("e"), "table:name").alias("sheet"), attribute(F.col("e"), "table:style-name").alias("style"))
    own = starts.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("chunk", "at")) - 1).alias("sheet_idx"), "sheet", "style")
    text = inflate(spark, paths, _CONTENT, "</table:table-row>").where(F.contains("text", F.lit("<style:style")))
    styles = text.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<style:style\s[^>]*[^/]>.*?</style:style>"), F.lit(0))).alias("e")).where(F.contains("e", F.lit("<style:table-properties")))
    shown = styles.select("path", attribute(F.col("e"), "style:name").alias("style"), attribute(F.regexp_extract("e", r"(<style:table-properties[^>]*>)", 1), "table:display").alias("shown")).dropDuplicates(["path", "style"])
    visible = F.when(F.col("shown") == "false", "hidden").otherwise("visible")
    return own.join(shown, ["path", "style"], "left").select("path", "sheet_idx", "sheet", F.lit("worksheet").alias("type"), visible.alias("visible"), F.lit(False).alias("is_1904"))


def defined_names(spark: SparkSession, paths) -> DataFrame:
    """(path, name, formula): named ranges and expressions, their addresses as they are written."""
    text = inflate(spark, paths, _CONTENT, "</table:table-row>").where(F.contains("text", F.lit("<table:named-")))
    own = text.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<table:named-(?:range|expression)\s[^>]*>"), F.lit(0))).alias("e"))
    e = F.col("e")
    return own.select("path", attribute(e, "table:name").alias("name"), F.coalesce(attribute(e, "table:cell-range-address"), attribute(e, "table:expression"), F.lit("")).alias("formula"))


def _text(cell: Column) -> Column:
    """Paragraphs joined by line ends; annotations left out; counted spaces written out."""
    bare = F.regexp_replace(cell, r"(?s)<office:annotation\b.*?</office:annotation>", "")
    paragraphs = F.regexp_extract_all(bare, F.lit(r"(?s)<text:p(?:\s[^>]*?)?/>|<text:p(?:\s[^>]*)?>(.*?)</text:p>"), F.lit(0))

    def one(p: Column) -> Column:
        parts = F.regexp_extract_all(p, F.lit(r"(?s)<text:s(?:\s[^>]*)?/>|[^<]+|<[^>]*>"), F.lit(0))
        return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^<text:s[\s/]"), F.repeat(F.lit(" "), F.coalesce(attribute(t, "text:c").try_cast("int"), F.lit(1)))).when(t.startswith("<"), "").otherwise(unescape(t))), "")

    return F.array_join(F.transform(paragraphs, one), "\n")


def cells(spark: SparkSession, paths, last_row: int | None = None) -> DataFrame:
    """The cell relation: repeated rows and cells written out where they hold something. Every file is opened once.

    paths may be what ``opened`` returns. last_row (from 0): chunks that begin behind it and start no table are left out.
    """
    own = opened(spark, paths, members=_CONTENT).where(F.col("usual").rlike(f"^{_CONTENT}$"))
    if last_row is not None:
        own = own.where((F.col("line") <= last_row) | F.col("text").rlike(r"<table:table[\s>]"))
    ship(spark)
    found = own.repartition("path", "chunk").select("path", "sheet_idx", "sheet", "line", "text").mapInArrow(_split(last_row), _SPLIT)
    split = ["path", "sheet_idx", "sheet", "row", "n", "scol", "st", "sname", "sp"]
    other = F.col("e").isNotNull()
    sized = F.transform(F.regexp_extract_all("e", F.lit(_CELL), F.lit(0)), lambda c: F.struct(c.alias("c"), F.least(_repeat(F.regexp_extract(c, r"(?s)^(<[^>]*>)", 1), "table:number-columns-repeated"), F.lit(MAX_COLUMNS)).alias("n")))
    found = found.select(*split, F.nullif(unescape(F.col("sv")), F.lit("")).alias("sv"), F.when(other, sized).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("c"), F.lit(1).alias("n")))).alias("s"))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.n)))
    found = found.select(*split, "sv", F.when(F.col("scol").isNull(), ends).alias("at"), F.posexplode("s").alias("k", "x"))
    other = F.col("x.c").isNotNull()
    head = F.regexp_extract("x.c", r"(?s)^(<[^>]*>)", 1)
    value = lambda k: F.when(other, attribute(head, f"office:{k}")).when(F.col("sname") == k, F.col("sv"))
    own = found.select(
        "path", "sheet", "sheet_idx", "row", "n", F.coalesce("scol", F.col("at")[F.col("k")]).alias("col"), F.col("x.n").alias("m"), F.when(other, attribute(head, "office:value-type")).otherwise(F.col("st")).alias("t"), value("value").try_cast("double").alias("f"), value("string-value").alias("sv"), value("date-value").alias("d"), value("time-value").alias("tv"),
        value("boolean-value").alias("bv"), F.when(other, attribute(head, "table:formula")).alias("formula"), F.when(other, _text(F.col("x.c"))).otherwise(unescape(F.col("sp"))).alias("text"),
    )
    kind = F.when(F.col("f").isNotNull(), "float").when(F.col("sv").isNotNull(), "string").when(F.col("d").isNotNull(), "datetime_iso").when(F.col("tv").isNotNull(), "duration_iso").when(F.col("bv").isNotNull(), "bool").when(F.col("t") == "string", "string").otherwise("empty")
    own = own.withColumn("kind", kind).where("kind <> 'empty' OR formula IS NOT NULL")
    own = own.withColumn("row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("n") - 1))).withColumn("col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("m") - 1)))
    none = F.lit(None)
    text = F.when(F.col("kind") == "string", F.coalesce("sv", "text")).when(F.col("kind") == "datetime_iso", F.col("d")).when(F.col("kind") == "duration_iso", F.col("tv"))
    return own.select(
        "path", "sheet", "sheet_idx", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "kind", none.cast("bigint").alias("i"), F.when(F.col("kind") == "float", F.col("f")).alias("f"), text.alias("s"),
        F.when(F.col("kind") == "bool", F.col("bv") == "true").alias("b"), F.lit(False).alias("is_1904"), "formula", F.when(F.col("formula").isNotNull(), "normal").alias("formula_kind"), none.cast("int").alias("shared_index"),
    ).to(spark.createDataFrame([], CELLS).schema)
