"""xlsb workbooks as the cell relation.

A helper cuts members into their records and carries the row number and the current block along, which only
the order of records tells, and turns the tokens of formulas into pieces; all other layouts are decoded by SQL functions, and
strings, styles, external sheets and names are joined.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import formats
from ..functions.library import functions as function_index
from ..model import CELLS, ERROR_CODES
from ..shipping import ship
from . import tokens
from .parts import files
from .xlsx import relationships

# Record types.
ROW, RK, ERROR, BOOL, REAL, TEXT, SHARED, F_TEXT, F_REAL, F_BOOL, F_ERROR = 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11
STRING, NAME, FORMAT, XF, BOOK, SHEET, EXTERN, BEGIN_XFS, END_XFS = 19, 39, 44, 47, 153, 156, 362, 617, 618
SCHEMA = f"path string, member string, seq long, row long, block int, type int, data binary, pieces {tokens.PIECES}"
_PIECES = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.int32())]))
BATCH = 20_000


def pieces_array(column: Iterable[list[dict] | None]) -> pa.Array:
    """Pieces of formulas as an Arrow array, made of flat columns."""
    ends, flat, n = [], [], 0
    for own in column:
        ends.append(None if own is None else n)
        if own:
            flat += own
            n += len(own)
    kinds, texts, refs = ([p[k] for p in flat] for k in ("kind", "text", "ref"))
    return pa.ListArray.from_arrays(pa.array([*ends, n], pa.int32()), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(refs, pa.int32())], ["kind", "text", "ref"]))


def batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    """Rows whose last value is the pieces of a formula."""
    *columns, own = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pieces_array(own)], names=names)


def record_stream(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(type, body) of each record; ends quietly where the data are cut off."""
    at, end = 0, len(data)
    while at < end:
        kind, size = data[at] & 0x7F, 0
        at += 1
        if data[at - 1] & 0x80:
            if at >= end:
                return
            kind |= (data[at] & 0x7F) << 7
            at += 1
        for k in range(4):
            if at >= end:
                return
            byte = data[at]
            at += 1
            size |= (byte & 0x7F) << 7 * k
            if not byte & 0x80:
                break
        if at + size > end:
            return
        yield kind, data[at : at + size]
        at += size


def formula_tokens(kind: int, body: memoryview) -> memoryview | None:
    """The tokens of a cell's or a name's formula behind their length; None for other records."""

    def long(at: int) -> int:
        return int.from_bytes(body[at : at + 4], "little")

    at = {F_REAL: 18, F_BOOL: 11, F_ERROR: 11}.get(kind)
    if kind == F_TEXT:
        at = 14 + 2 * long(8)
    elif kind == NAME:
        at = 13 + 2 * long(9)
    return None if at is None else body[at + 4 : at + 4 + long(at)]


def records(spark: SparkSession, paths, members: str, types: list[int], functions=None, last_row: int | None = None) -> DataFrame:
    """Records of the given types in the members that match, of all zipped workbooks under the paths; none behind the last row that is asked for."""
    ship(spark)
    wanted, index = frozenset(types), function_index(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, names = re.compile(members), ["path", "member", "seq", "row", "block", "type", "data", "pieces"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), _PIECES]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = content.as_buffer()
                if raw[:2].to_pybytes() != b"PK":
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        member = info.filename.replace("\\", "/").lower()
                        if not pattern.fullmatch(member):
                            continue
                        rows, row, block = [], -1, -1
                        for seq, (kind, body) in enumerate(record_stream(memoryview(z.read(info)))):
                            if kind == ROW and len(body) >= 4:
                                row = int.from_bytes(body[:4], "little")
                                if last_row is not None and row > last_row:
                                    break
                            elif kind in (BEGIN_XFS, END_XFS):
                                block = kind
                            if kind in wanted:
                                own = formula_tokens(kind, body)
                                rows.append((path, member, seq, row, block, kind, bytes(body), None if own is None else tokens.rows_of(own, tokens.XLSB, functions=index)))
                            if len(rows) >= BATCH:
                                yield batch_of(rows, kinds, names)
                                rows = []
                        if rows:
                            yield batch_of(rows, kinds, names)

    return files(spark, paths).mapInArrow(run, SCHEMA)


def sheets(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet_idx, sheet, type, visible, is_1904, member) in workbook order; sheets without a part are left out."""
    got = records(spark, paths, r"[^/]*/workbook\.bin", [BOOK, SHEET])
    flags = got.where(F.col("type") == BOOK).groupBy("path").agg(F.max(B.unsigned(F.col("data"), 0, 4).bitwiseAND(F.lit(1)) == 1).alias("is_1904"))
    own = got.where(F.col("type") == SHEET).select("path", "seq", B.unsigned(F.col("data"), 0, 4).alias("state"), B.wide_text(F.col("data"), 8).alias("id"), B.wide_text(F.col("data"), 12 + 2 * F.coalesce(F.nullif(B.unsigned(F.col("data"), 8, 4), F.lit(0xFFFFFFFF)), F.lit(0))).alias("sheet"))
    own = own.where("id IS NOT NULL").withColumn("sheet_idx", F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1)
    rels = relationships(spark, paths, r"[^/]*/_rels/workbook\.bin\.rels").select("path", "id", F.col("target").alias("member"), "type")
    visible = F.when(F.col("state") == 0, "visible").when(F.col("state") == 1, "hidden").otherwise("veryHidden")
    return own.join(rels, ["path", "id"]).join(flags, "path", "left").select("path", "sheet_idx", "sheet", "type", visible.alias("visible"), F.coalesce("is_1904", F.lit(False)).alias("is_1904"), "member")


def styles(spark: SparkSession, paths) -> DataFrame:
    """(path, style, class); built-in formats go before custom ones of the same number."""
    got = records(spark, paths, r"[^/]*/styles\.bin", [FORMAT, XF])
    custom = got.where(F.col("type") == FORMAT).select("path", B.unsigned(F.col("data"), 0, 2).alias("fmt"), formats.custom_class(B.wide_text(F.col("data"), 2)).alias("custom")).dropDuplicates(["path", "fmt"])
    xfs = got.where((F.col("type") == XF) & (F.col("block") == BEGIN_XFS)).select("path", B.unsigned(F.col("data"), 2, 2).alias("fmt"), (F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1).alias("style"))
    builtin = formats.builtin_class(F.col("fmt"))
    return xfs.join(custom, ["path", "fmt"], "left").select("path", "style", F.when(builtin != "other", builtin).otherwise(F.coalesce("custom", F.lit("other"))).alias("class"))


def shared_strings(spark: SparkSession, paths) -> DataFrame:
    got = records(spark, paths, r"[^/]*/sharedstrings\.bin", [STRING])
    return got.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1).alias("index"), B.wide_text(F.col("data"), 1).alias("text"))


def external_sheets(spark: SparkSession, paths) -> DataFrame:
    """(path, ref, sheet): what the external-sheet index of a workbook stands for; an entry without a sheet says why."""
    got = records(spark, paths, r"[^/]*/workbook\.bin", [EXTERN])
    data = F.col("data")
    count = F.least(B.unsigned(data, 0, 4), F.floor((F.length(data) - 4) / 12)).cast("int")
    entry = got.where(count > 0).select("path", "data", F.explode(F.sequence(F.lit(0), count - 1)).alias("ref"))
    first = B.unsigned(data, 8 + 12 * F.col("ref"), 4)
    own = entry.select("path", "ref", F.when(first >= 1 << 31, first - (1 << 32)).otherwise(first).alias("first"))
    known = sheets(spark, paths).select("path", F.col("sheet_idx").cast("long").alias("first"), "sheet")
    other = F.when(F.col("first") == -2, "#ThisWorkbook").when(F.col("first") == -1, "#InvalidWorkSheet").otherwise("#Unknown")
    return own.join(known, ["path", "first"], "left").select("path", "ref", F.coalesce("sheet", other).alias("sheet"))


def by_number(rows: DataFrame, number: str, value: str, into: str) -> DataFrame:
    """(path, into): a map of each workbook's small index."""
    return rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(number, value))).alias(into))


def _names(spark: SparkSession, paths, functions=None) -> DataFrame:
    """(path, ref, name, pieces); names count from 1."""
    got = records(spark, paths, r"[^/]*/workbook\.bin", [NAME], functions)
    return got.select("path", F.row_number().over(Window.partitionBy("path").orderBy("seq")).alias("ref"), B.wide_text(F.col("data"), 9).alias("name"), "pieces")


def books(external: DataFrame, names: DataFrame, sheets_of: DataFrame | None = None, key: str = "", styles_of: DataFrame | None = None) -> DataFrame:
    """(path, _sheets, _names, and if given _members and _classes): the small indexes of each workbook as maps, a row for each workbook.

    One join by workbook gives them to its rows. They are joined as they are and not by the size of files, which says little about
    rows: packages are compressed, and the cells of files that look small would be sent to every executor through the driver.
    """
    own = [by_number(external, "ref", "sheet", "_sheets"), by_number(names, "ref", "name", "_names")]
    if sheets_of is not None:
        placed = sheets_of.groupBy("path", F.col(key).alias("_key")).agg(F.collect_list(F.struct("sheet", "sheet_idx", "is_1904")).alias("_own"))
        own += [by_number(placed, "_key", "_own", "_members"), by_number(styles_of, "style", "class", "_classes")]
    found = own[0]
    for more in own[1:]:
        found = found.join(more, "path", "full")
    return found.hint("shuffle_hash")


def _formulas(met: DataFrame) -> DataFrame:
    failed = tokens.failure(F.col("pieces"))
    return met.withColumn("failure", failed).withColumn("formula", F.when(failed.isNull(), tokens.resolved(F.col("pieces"), F.col("_sheets"), F.col("_names")))).drop("_sheets", "_names", "pieces")


def with_texts(rows: DataFrame, external: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (path, pieces, ...) with formula and failure, sheets and names looked up in the workbook's indexes."""
    return _formulas(rows.join(books(external, names), "path", "left"))


def with_books(rows: DataFrame, external: DataFrame, names: DataFrame, sheets_of: DataFrame, key: str, styles_of: DataFrame) -> DataFrame:
    """Cells (path, key, style, pieces, ...) with formula and failure, their sheet (sheet, sheet_idx, is_1904; those of no sheet are left out) and class."""
    met = rows.withColumnRenamed(key, "_key").join(books(external, names, sheets_of, key, styles_of), "path")
    placed = met.select("*", F.inline(F.try_element_at("_members", F.col("_key"))), F.try_element_at("_classes", F.col("style")).alias("class"))
    return _formulas(placed.drop("_key", "_members", "_classes"))


def defined_names(spark: SparkSession, paths, functions=None) -> DataFrame:
    """(path, name, formula)."""
    own = _names(spark, paths, functions)
    texts = with_texts(own, external_sheets(spark, paths), own)
    wrong = F.raise_error(F.concat(F.lit("formula of a name: "), F.col("failure"))).cast("string")
    return texts.select("path", "name", F.when(F.col("failure").isNull(), F.coalesce("formula", F.lit(""))).otherwise(wrong).alias("formula"))


def cells(spark: SparkSession, paths, functions=None, last_row: int | None = None) -> DataFrame:
    """The cell relation. A formula whose tokens cannot be read raises where its text is asked for; a cell of a shared or array formula has none.

    functions: more of the function index, as a dict or a relation (``functions.library``).
    """
    got = records(spark, paths, r"[^/]*/worksheets/[^/]*\.bin", [RK, ERROR, BOOL, REAL, TEXT, SHARED, F_TEXT, F_REAL, F_BOOL, F_ERROR], functions, last_row)
    data, t = F.col("data"), F.col("type")
    own = got.select(
        "path", "member", F.col("row").cast("int").alias("row"), B.unsigned(data, 0, 4).cast("int").alias("col"), B.unsigned(data, 4, 3).cast("int").alias("style"), "type",
        F.when(t == RK, B.unsigned(data, 8, 4)).alias("rk"), F.when(t.isin(REAL, F_REAL), B.double(data, 8)).alias("real"), F.when(t.isin(TEXT, F_TEXT), B.wide_text(data, 8)).alias("own_text"),
        F.when(t == SHARED, B.unsigned(data, 8, 4).cast("int")).alias("index"), F.when(t.isin(ERROR, BOOL, F_ERROR, F_BOOL), B.unsigned(data, 8, 1)).alias("byte"), "pieces",
    )
    named = sheets(spark, paths).select("path", "member", "sheet", "sheet_idx", "is_1904")
    own = with_books(own, external_sheets(spark, paths), _names(spark, paths), named, "member", styles(spark, paths))
    own = own.join(shared_strings(spark, paths), ["path", "index"], "left")
    own = own.withColumn("whole", B.rk_integer(F.col("rk"))).withColumn("number", F.coalesce("real", B.rk_double(F.col("rk"))))
    errors = F.create_map(*(F.lit(x) for kv in ERROR_CODES.items() for x in kv))
    lost = F.raise_error(F.concat(F.lit("no shared string "), F.col("index").cast("string"))).cast("string")
    dated = F.col("class").isin("datetime", "timedelta")
    kind = F.when(t.isin(TEXT, F_TEXT, SHARED), "string").when(t.isin(BOOL, F_BOOL), "bool").when(t.isin(ERROR, F_ERROR), "error").otherwise(formats.number_kind(F.coalesce("class", F.lit("other")), F.col("whole").isNotNull()))
    wrong = F.raise_error(F.concat(F.lit("formula of cell "), F.col("row"), F.lit(", "), F.col("col"), F.lit(": "), F.col("failure"))).cast("string")
    formula = F.when(F.col("failure").isNull(), F.col("formula")).otherwise(wrong)
    return own.select(
        "path", "sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"), "row", "col", kind.alias("kind"), F.when(~F.coalesce(dated, F.lit(False)), F.col("whole")).alias("i"),
        F.when(F.coalesce(dated, F.lit(False)) | F.col("whole").isNull(), F.col("number")).alias("f"),
        F.when(t == SHARED, F.coalesce("text", lost)).when(t.isin(ERROR, F_ERROR), errors[F.col("byte").cast("int")]).otherwise(F.col("own_text")).alias("s"), F.when(t.isin(BOOL, F_BOOL), F.col("byte") != 0).alias("b"),
        "is_1904", formula.alias("formula"), F.when(F.col("formula").isNotNull(), "normal").alias("formula_kind"), F.lit(None).cast("int").alias("shared_index"),
    ).to(spark.createDataFrame([], CELLS).schema)
