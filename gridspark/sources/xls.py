"""xls workbooks (BIFF5 and BIFF8 in compound files) as the cell relation.

A helper follows the sectors of the compound file, cuts the workbook stream into records and resolves what only
their order tells: which sheet a record belongs to, texts that run on in continuation records, and the cell that
a formula's text result belongs to; and it turns the tokens of formulas into pieces. Layouts are decoded by SQL functions; strings, styles,
external sheets and names are joined.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import formats
from ..functions.library import functions as function_index
from ..model import CELLS, ERROR_CODES
from ..shipping import ship
from . import tokens
from .compound import MAGIC, Compound
from .parts import files
from .xlsb import _PIECES, batch_of, with_books, with_texts

# Record types.
FORMULA, EOF, EXTERN, NAME, DATE_MODE, PROTECTED, CONTINUE, CODE_PAGE, SHEET, PACKED_ROW, RICH_TEXT, XF, MERGES, STRINGS, SHARED = 0x06, 0x0A, 0x17, 0x18, 0x22, 0x2F, 0x3C, 0x42, 0x85, 0xBD, 0xD6, 0xE0, 0xE5, 0xFC, 0xFD
DIMENSIONS, NUMBER, LABEL, BOOL_ERROR, RESULT_TEXT, PACKED, FORMAT, BEGIN = 0x200, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E, 0x809
# Names of the workbook stream, and code pages that Python calls otherwise.
STREAMS = ("Workbook", "Book", "WORKBOOK", "BOOK")
CODECS = {367: "ascii", 1200: "latin-1", 10000: "mac_roman", 21010: "latin-1", 32768: "mac_roman", 32769: "cp1252", 65001: "utf-8"}
IN_SHEETS = frozenset({FORMULA, PACKED_ROW, RICH_TEXT, MERGES, SHARED, DIMENSIONS, NUMBER, LABEL, BOOL_ERROR, RESULT_TEXT, PACKED})
CELL_TYPES = [FORMULA, PACKED_ROW, RICH_TEXT, SHARED, NUMBER, LABEL, BOOL_ERROR, RESULT_TEXT, PACKED]
SCHEMA = f"path string, sheet_idx int, seq long, type int, data binary, text string, pieces {tokens.PIECES}"
BATCH = 20_000


def workbook_stream(data: memoryview) -> bytes | None:
    """The workbook stream of a compound file; None if it has none. ValueError where sectors lie outside the file."""
    file = Compound(data)
    found = {e[0]: e[5:] for e in reversed(file.entries[1:])}
    name = next((n for n in STREAMS if n in found), None)
    return None if name is None else file.read(*found[name])


def record_stream(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of each record of the substream that begins at a place, up to its end; embedded substreams are left out.

    Parts after the first are continuations.
    """
    depth, held = 0, None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("a record is cut off")
        at += 4 + size
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held and depth == 1:
            yield held
        held = None
        if kind == BEGIN:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if depth <= 0:
                return
            continue
        held = (kind, [body])
        if kind == BEGIN and depth == 2:
            held = None
    if held and depth == 1:
        yield held


class Cursor:
    """Reads on over the parts of a continued record; in a text, each further part begins with a byte for its width."""

    def __init__(self, parts: list[bytes], at: int = 0) -> None:
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        got = b""
        while len(got) < n and self.more():
            own = self.parts[self.k][self.at : self.at + n - len(got)]
            got, self.at = got + own, self.at + len(own)
        return got

    def more(self) -> bool:
        while self.at >= len(self.parts[self.k]) and self.k + 1 < len(self.parts):
            self.k, self.at = self.k + 1, 0
        return self.at < len(self.parts[self.k])

    def text(self, n: int, wide: bool) -> str:
        got = b""
        while n > 0:
            own = self.parts[self.k][self.at :]
            m = min(n, len(own) // (2 if wide else 1))
            own = own[: 2 * m] if wide else own[:m].decode("latin-1").encode("utf-16-le")
            got, n, self.at = got + own, n - m, self.at + m * (2 if wide else 1)
            if n > 0:
                if self.k + 1 >= len(self.parts):
                    raise ValueError("a text is cut off")
                self.k, self.at = self.k + 1, 1
                wide = bool(self.parts[self.k][:1] > b"\0" and self.parts[self.k][0] & 1)
        return got.decode("utf-16-le", "replace")


def text_at(parts: list[bytes], at: int, size: int, codec: str | None) -> str:
    """A text behind its length of ``size`` bytes; of the older format where a codec is given."""
    c = Cursor(parts, at)
    n = int.from_bytes(c.take(size), "little")
    if codec:
        return c.take(n).decode(codec, "replace")
    return c.text(n, bool(c.take(1) > b"\0" and parts[c.k][c.at - 1] & 1))


def string_items(parts: list[bytes]) -> Iterator[str]:
    """The texts of the table of shared strings; runs and extensions are passed over."""
    c = Cursor(parts, 8)
    while c.more():
        head = c.take(3)
        if len(head) < 3:
            return
        runs = int.from_bytes(c.take(2), "little") if head[2] & 8 else 0
        extra = int.from_bytes(c.take(4), "little") if head[2] & 4 else 0
        yield c.text(int.from_bytes(head[:2], "little"), bool(head[2] & 1))
        c.take(4 * runs + extra)


def dialect(old: bool) -> str:
    return tokens.BIFF5 if old else tokens.BIFF8


def workbook_records(data: bytes, wanted: frozenset[int], codepage: int | None, functions: dict | None = None) -> Iterator[tuple[int, int, bytes, str | None, list | None]]:
    """(sheet, or -1 for the workbook; type; data; text; pieces of a formula) of the wanted records.

    Text results get the head of their formula's record, and both have the formula's pieces.
    """
    codec, old, starts = CODECS.get(codepage, f"cp{codepage}") if codepage else "latin-1", False, []
    for kind, parts in record_stream(data):
        body = parts[0]
        if kind == BEGIN:
            old = len(body) >= 2 and body[:2] != b"\0\6"
        elif kind == CODE_PAGE and not codepage:
            page = int.from_bytes(body[:2], "little")
            codec = CODECS.get(page, f"cp{page}")
        elif kind == PROTECTED and body[:2] != b"\0\0":
            if kind not in wanted:
                raise ValueError("protected by a password")
            yield -1, kind, body, None, None
            return
        elif kind == SHEET:
            starts.append(int.from_bytes(body[:4], "little"))
            if kind in wanted:
                yield -1, kind, body, text_at(parts, 6, 1, codec if old else None).replace("\0", ""), None
        elif kind == STRINGS and kind in wanted:
            for text in string_items(parts):
                yield -1, kind, b"", text, None
        elif kind == FORMAT and kind in wanted:
            yield -1, kind, body, text_at(parts, 2, 1 if old else 2, codec if old else None), None
        elif kind == NAME and kind in wanted:
            body = b"".join(parts)
            n, size = body[3], int.from_bytes(body[4:6], "little")
            raw = body[14 : 14 + n] if old else body[15 : 15 + n * (1 + (body[14] & 1))]
            yield -1, kind, b"", raw.decode(codec if old else "utf-16-le" if body[14] & 1 else "latin-1", "replace"), tokens.rows_of(body[len(body) - size :], dialect(old), codec, functions)
        elif kind in wanted:  # an older index of sheets is no list of numbers
            yield -1, kind, b"" if kind == EXTERN and old else b"".join(parts) if kind == EXTERN else body, None, None
    if not wanted & IN_SHEETS:
        return
    for k, start in enumerate(starts):
        place, own = b"", None
        for kind, parts in record_stream(data, start):
            if kind == FORMULA:
                place, own = parts[0][:6], None
                if FORMULA in wanted:
                    body = b"".join(parts)
                    own = tokens.rows_of(body[22 : 22 + int.from_bytes(body[20:22], "little")], dialect(old), codec, functions)
            if kind not in wanted:
                continue
            if kind in (LABEL, RICH_TEXT):
                yield k, kind, parts[0], text_at(parts, 6, 2, codec if old else None), None
            elif kind == RESULT_TEXT:
                yield k, kind, place, text_at(parts, 0, 2, codec if old else None), own
            else:
                yield k, kind, parts[0], None, own if kind == FORMULA else None


def records(spark: SparkSession, paths, types: list[int], codepage: int | None = None, strict: bool = True, functions=None, report: bool = False) -> DataFrame:
    """Records of the given types of all compound files under the paths; broken files raise, or are passed by if not strict.

    report: no records, but a row of type -1 for each broken file, with what is wrong as its text.
    """
    ship(spark)
    wanted, index = frozenset(types), function_index(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "sheet_idx", "seq", "type", "data", "text", "pieces"], [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), _PIECES]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = memoryview(content.as_buffer())
                if bytes(raw[:8]) != MAGIC:
                    continue
                rows = []
                try:
                    stream = workbook_stream(raw)
                    if stream is None:
                        raise ValueError("no workbook stream")
                    for seq, own in enumerate(workbook_records(stream, wanted, codepage, index)):
                        if report:
                            continue
                        rows.append((path, own[0], seq, *own[1:]))
                        if len(rows) >= BATCH:
                            yield batch_of(rows, kinds, names)
                            rows = []
                except (ValueError, IndexError, LookupError, struct.error) as e:
                    if report:
                        rows.append((path, -1, 0, -1, None, str(e), None))
                    elif strict:
                        raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield batch_of(rows, kinds, names)

    return files(spark, paths).mapInArrow(run, SCHEMA)


def protected(spark: SparkSession, paths) -> DataFrame:
    """(path) of workbooks under a password."""
    return records(spark, paths, [PROTECTED], strict=False).select("path").distinct()


def sheets(spark: SparkSession, paths, codepage: int | None = None, strict: bool = True) -> DataFrame:
    """(path, sheet_idx, sheet, type, visible, is_1904) in workbook order."""
    got = records(spark, paths, [SHEET, DATE_MODE], codepage, strict)
    flags = got.where(F.col("type") == DATE_MODE).groupBy("path").agg(F.max(B.unsigned(F.col("data"), 0, 2) == 1).alias("is_1904"))
    state, kind = B.unsigned(F.col("data"), 4, 1).bitwiseAND(F.lit(63)), B.unsigned(F.col("data"), 5, 1)
    unknown = F.raise_error(F.concat(F.lit("no such state or type of a sheet: "), F.col("text"))).cast("string")
    own = got.where(F.col("type") == SHEET).select(
        "path", (F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1).alias("sheet_idx"), F.col("text").alias("sheet"),
        F.when(kind == 0, "worksheet").when(kind == 1, "macrosheet").when(kind == 2, "chartsheet").when(kind == 6, "vba").otherwise(unknown).alias("type"),
        F.when(state == 0, "visible").when(state == 1, "hidden").when(state == 2, "veryHidden").otherwise(unknown).alias("visible"),
    )
    return own.join(flags, "path", "left").withColumn("is_1904", F.coalesce("is_1904", F.lit(False)))


def styles(spark: SparkSession, paths, codepage: int | None = None, strict: bool = True) -> DataFrame:
    """(path, style, class); custom formats go before built-in ones of the same number."""
    got = records(spark, paths, [FORMAT, XF], codepage, strict)
    custom = got.where(F.col("type") == FORMAT).groupBy("path", B.unsigned(F.col("data"), 0, 2).alias("fmt")).agg(F.max_by("text", "seq").alias("code")).select("path", "fmt", formats.custom_class(F.col("code")).alias("custom"))
    xfs = got.where(F.col("type") == XF).select("path", B.unsigned(F.col("data"), 2, 2).alias("fmt"), (F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1).alias("style"))
    return xfs.join(custom, ["path", "fmt"], "left").select("path", "style", F.coalesce("custom", formats.builtin_class(F.col("fmt"))).alias("class"))


def shared_strings(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    got = records(spark, paths, [STRINGS], strict=strict)
    # only strings are asked for, so their places in the helper's output are their numbers
    return got.select("path", F.col("seq").cast("int").alias("index"), "text")


def merges(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(path, sheet, sheet_idx, r0, c0, r1, c1)."""
    got = records(spark, paths, [MERGES], strict=strict)
    n = B.unsigned(F.col("data"), 0, 2).cast("int")
    at = got.where(n > 0).select("path", "sheet_idx", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    part = lambda j: B.unsigned(F.col("data"), F.col("k") * 8 + 2 + 2 * j, 2)
    own = at.select("path", "sheet_idx", part(0).alias("r0"), part(2).alias("c0"), part(1).alias("r1"), part(3).alias("c1"))
    return own.join(sheets(spark, paths, strict=strict).select("path", "sheet_idx", "sheet"), ["path", "sheet_idx"]).select("path", "sheet", "sheet_idx", "r0", "c0", "r1", "c1")


def external_sheets(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(path, ref, sheet): the sheets that formulas name by number; an older workbook's numbers are the sheets' own."""
    got, known = records(spark, paths, [EXTERN], strict=strict), sheets(spark, paths, strict=strict).select("path", "sheet_idx", "sheet")
    data = F.col("data")
    count = F.least(B.unsigned(data, 0, 2), F.floor((F.length(data) - 2) / 6)).cast("int")
    entry = got.where(count > 0).select("path", "seq", "data", F.posexplode(F.sequence(F.lit(0), count - 1)).alias("k", "at"))
    own = entry.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("seq", "k")) - 1).alias("ref"), B.unsigned(data, 4 + 6 * F.col("at"), 2).cast("int").alias("sheet_idx"))
    plain = known.join(own.select("path").distinct(), "path", "left_anti").select("path", F.col("sheet_idx").alias("ref"), "sheet")
    return own.join(known, ["path", "sheet_idx"]).select("path", "ref", "sheet").unionByName(plain)


def _names(spark: SparkSession, paths, codepage: int | None = None, strict: bool = True, functions=None) -> DataFrame:
    """(path, ref, name, pieces); names count from 1."""
    got = records(spark, paths, [NAME], codepage, strict, functions)
    return got.select("path", F.row_number().over(Window.partitionBy("path").orderBy("seq")).alias("ref"), F.col("text").alias("name"), "pieces")


def defined_names(spark: SparkSession, paths, codepage: int | None = None, strict: bool = True, functions=None) -> DataFrame:
    """(path, name, formula); a formula that cannot be read says so in its text, and one without tokens is ``empty rgce``."""
    own = _names(spark, paths, codepage, strict, functions)
    texts = with_texts(own, external_sheets(spark, paths, strict), own)
    return texts.select("path", "name", F.when(F.col("failure").isNotNull(), F.concat(F.lit("Unsupported: "), F.col("failure"))).otherwise(F.coalesce("formula", F.lit("empty rgce"))).alias("formula"))


def _byte(at: int) -> Column:
    return B.unsigned(F.col("data"), at, 1)


def cells(spark: SparkSession, paths, codepage: int | None = None, strict: bool = True, functions=None) -> DataFrame:
    """The cell relation. Cells of strings that the table lacks are left out; a formula that cannot be read says so in its text.

    ``codepage`` goes before the one that a workbook of the older format names; ``functions`` widens the function index.
    """
    data, t = F.col("data"), F.col("type")
    got = records(spark, paths, CELL_TYPES, codepage, strict, functions)
    last = F.when(t == PACKED_ROW, F.floor((F.length(data) - 6) / 6).cast("int") - 1).otherwise(0)
    got = got.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    step, packed = F.col("k") * 6, t.isin(PACKED, PACKED_ROW)
    special = (t == FORMULA) & (B.unsigned(data, 12, 2) == 0xFFFF)
    own = got.select(
        "path", "sheet_idx", "type", "text", B.unsigned(data, 0, 2).cast("int").alias("row"), (B.unsigned(data, 2, 2) + F.col("k")).cast("int").alias("col"), B.unsigned(data, step + 4, 2).cast("int").alias("style"),
        F.when(packed, B.unsigned(data, step + 6, 4)).alias("rk"), F.when((t == NUMBER) | ((t == FORMULA) & ~special), B.double(data, 6)).alias("real"),
        F.when(t == SHARED, B.unsigned(data, 6, 4).cast("int")).alias("index"), F.when(special, _byte(6)).alias("result"),
        F.when(t == BOOL_ERROR, _byte(6)).when(special, _byte(8)).alias("byte"), F.when(t == BOOL_ERROR, _byte(7)).alias("flag"), "pieces",
    ).where("result IS NULL OR result <> 0")  # the text of such a formula is a record of its own
    own = with_books(own, external_sheets(spark, paths, strict), _names(spark, paths, codepage, strict), sheets(spark, paths, codepage, strict), "sheet_idx", styles(spark, paths, codepage, strict))
    texts = shared_strings(spark, paths, strict).withColumnRenamed("text", "shared")
    own = own.join(texts, ["path", "index"], "left").where((t != SHARED) | F.col("shared").isNotNull())
    own = own.withColumn("whole", B.rk_integer(F.col("rk"))).withColumn("number", F.coalesce("real", B.rk_double(F.col("rk"))))
    result, dated = F.col("result"), F.coalesce(F.col("class").isin("datetime", "timedelta"), F.lit(False))
    is_bool, is_error = (F.coalesce(c, F.lit(False)) for c in ((F.col("flag") == 0) | (result == 1), (F.col("flag") == 1) | (result == 2)))
    is_text = F.coalesce(t.isin(LABEL, RICH_TEXT, RESULT_TEXT, SHARED) | (result == 3), F.lit(False))
    errors = F.create_map(*(F.lit(x) for kv in ERROR_CODES.items() for x in kv))
    unknown = F.raise_error(F.concat(F.lit("no such error code: "), F.col("byte").cast("string"))).cast("string")
    kind = F.when(is_text, "string").when(is_bool, "bool").when(is_error, "error").otherwise(formats.number_kind(F.coalesce("class", F.lit("other")), F.col("whole").isNotNull()))
    plain = ~(is_text | is_bool | is_error)
    unread = F.concat(F.lit("Unrecognised formula for cell ("), F.col("row"), F.lit(", "), F.col("col"), F.lit("): "), F.col("failure"))
    formula = F.when(F.col("failure").isNull(), F.col("formula")).otherwise(unread)
    return own.select(
        "path", "sheet", "sheet_idx", "row", "col", kind.alias("kind"), F.when(plain & ~dated, F.col("whole")).alias("i"), F.when(plain & (dated | F.col("whole").isNull()), F.col("number")).alias("f"),
        F.when(is_error, F.coalesce(errors[F.col("byte").cast("int")], unknown)).when(is_text, F.coalesce("shared", "text", F.lit(""))).alias("s"), F.when(is_bool, F.col("byte") != 0).alias("b"),
        "is_1904", formula.alias("formula"), F.when(formula.isNotNull(), "normal").alias("formula_kind"), F.lit(None).cast("int").alias("shared_index"),
    ).to(spark.createDataFrame([], CELLS).schema)
