"""xlsx workbooks as relations: sheets, names, styles, strings, cells, merges, hyperlinks, tables.

Cells of the usual form are taken out of text chunks by one regular expression, the others and everything else is parsed by SQL
functions; lookups are joins: a cell meets its shared string by (path, index), its
style by (path, style) and a derived formula its anchor by (path, sheet, index). Sheet chunks are dealt out
before they are parsed, so that one large sheet is parsed by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, refs
from ..functions.once import once
from ..model import CELLS, ERROR_CODES, MAX_COLUMNS
from ..shipping import ship
from .parts import attribute, elements, inflate, opened, strings, unescape

_SHEETS = r"[^/]*/worksheets/[^/]*\.xml"
#: What cells are made of.
_CELL_PARTS = r"[^/]*/(?:worksheets/[^/]*\.xml|workbook\.xml|_rels/workbook\.xml\.rels|sharedstrings\.xml|styles\.xml)"


def _whole(spark: SparkSession, paths, member: str, broken: str = "raise") -> DataFrame:
    """Small members, their chunks joined."""
    got = inflate(spark, paths, member, broken=broken).groupBy("path", "member").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    return got.select("path", "member", F.array_join(F.transform("c", lambda x: x.text), "").alias("text"))


def relationships(spark: SparkSession, paths, member: str, broken: str = "raise") -> DataFrame:
    """(path, member, id, target, type) of relationship parts; targets relative to the package root, lower case."""
    found = _whole(spark, paths, member, broken).select("path", "member", F.explode(elements(F.col("text"), "Relationship")).alias("e"))
    base = F.regexp_extract("member", r"^(.*?)_rels/[^/]*$", 1)
    target = attribute(F.col("e"), "Target")
    full = F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat(base, target))
    full = F.regexp_replace(full, r"[^/]+/\.\./", "")
    return found.select("path", "member", attribute(F.col("e"), "Id").alias("id"), F.when(attribute(F.col("e"), "TargetMode") == "External", target).otherwise(F.lower(full)).alias("target"), F.regexp_extract(attribute(F.col("e"), "Type"), "([^/]*)$", 1).alias("type"))


def sheets(spark: SparkSession, paths, broken: str = "raise") -> DataFrame:
    """(path, sheet_idx, sheet, type, visible, is_1904, member) in workbook order."""
    book = _whole(spark, paths, r"[^/]*/workbook\.xml", broken)
    flag = attribute(F.element_at(elements(F.col("text"), "workbookPr"), 1), "date1904")
    own = book.select("path", F.coalesce(F.when(F.size(elements(F.col("text"), "workbookPr")) > 0, flag).isin("1", "true"), F.lit(False)).alias("is_1904"), F.posexplode(elements(F.col("text"), "sheet")).alias("sheet_idx", "e"))
    own = own.select("path", "sheet_idx", "is_1904", attribute(F.col("e"), "name").alias("sheet"), F.coalesce(attribute(F.col("e"), "state"), F.lit("visible")).alias("visible"), F.regexp_extract("e", r'[\s]\w+:id\s*=\s*"([^"]*)"', 1).alias("id"))
    rels = relationships(spark, paths, r"[^/]*/_rels/workbook\.xml\.rels", broken).select("path", "id", F.col("target").alias("member"), "type")
    return own.join(rels, ["path", "id"]).select("path", "sheet_idx", "sheet", "type", "visible", "is_1904", "member")


def defined_names(spark: SparkSession, paths) -> DataFrame:
    """(path, name, formula)."""
    found = _whole(spark, paths, r"[^/]*/workbook\.xml").select("path", F.explode(elements(F.col("text"), "definedName")).alias("e"))
    return found.select("path", attribute(F.col("e"), "name").alias("name"), unescape(F.regexp_extract("e", r"(?s)>(.*)</definedName>$", 1)).alias("formula"))


@once
def _custom_formats() -> list[Column]:
    return [F.col("path"), attribute(F.col("e"), "numFmtId").alias("fmt"), formats.custom_class(attribute(F.col("e"), "formatCode")).alias("custom")]


def styles(spark: SparkSession, paths, broken: str = "raise") -> DataFrame:
    """(path, style, class): number-format class of each cell format."""
    text = _whole(spark, paths, r"[^/]*/styles\.xml", broken)
    custom = text.select("path", F.explode(elements(F.col("text"), "numFmt")).alias("e")).select(*_custom_formats())
    block = F.regexp_extract("text", r"(?s)<cellXfs[^>]*>(.*?)</cellXfs>", 1)
    xfs = text.select("path", F.posexplode(F.regexp_extract_all(block, F.lit(r"(?s)<xf\b[^>]*>"), F.lit(0))).alias("style", "e")).select("path", "style", F.coalesce(attribute(F.col("e"), "numFmtId"), F.lit("0")).alias("fmt"))
    return xfs.join(custom.dropDuplicates(["path", "fmt"]), ["path", "fmt"], "left").select("path", "style", F.coalesce("custom", formats.builtin_class(F.col("fmt").try_cast("int"))).alias("class"))


def shared_strings(spark: SparkSession, paths, broken: str = "raise") -> DataFrame:
    """(path, index, text)."""
    got = inflate(spark, paths, r"[^/]*/sharedstrings\.xml", "</si>", broken=broken)
    items = F.regexp_extract_all("text", F.lit(r"(?s)<si\s*/>|<si(?:\s[^>]*)?>.*?</si>"), F.lit(0))
    # empty items close no element, so chunks count all items themselves
    sized = got.select("path", "chunk", items.alias("items"))
    before = F.coalesce(F.sum(F.size("items")).over(Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("before", before).select("path", "before", F.posexplode("items").alias("k", "e")).select("path", (F.col("before") + F.col("k")).cast("int").alias("index"), strings(F.col("e")).alias("text"))


def _chunks(spark: SparkSession, paths, only=None, last_row: int | None = None, broken: str = "raise") -> DataFrame:
    return inflate(spark, paths, _SHEETS, "</row>", only, last_row, broken)


#: A cell of the usual form: reference, perhaps style and type, and a value.
_PLAIN = re.compile(r'<c r="([A-Z]{1,3})([1-9][0-9]{0,6})"(?: s="([0-9]{1,9})")?(?: t="([A-Za-z]+)")?>(?:<v>([^<]*)</v>)?</c>')
_ANY = re.compile(r"<c[\s/>]")
_SPLIT = "path string, member string, srow int, scol int, sstyle int, st string, sv string, rest string"


def _columns(letters: pa.Array) -> pa.Array:
    """Numbers of columns by their letters, of which there are few."""
    own = letters.dictionary_encode()
    number = []
    for name in own.dictionary.to_pylist():
        n = 0
        for c in name:
            n = n * 26 + ord(c) - 64
        number.append(n - 1 if n <= MAX_COLUMNS else None)
    return pa.array(number, pa.int32()).take(own.indices)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the usual form, as columns; where a chunk has others, too, one row with the text that is left."""
    names = [c.split()[0] for c in _SPLIT.split(", ")]
    for b in batches:
        for path, member, text in (tuple(x.as_py() for x in own) for own in zip(*(b.column(c) for c in ("path", "member", "text")))):  # one text at a time
            found = _PLAIN.findall(text)
            n = len(found)
            if n:
                letters, rows, styles_, types, values = (pa.array(x) for x in zip(*found))
                filled = lambda x: pc.if_else(pc.equal(x, ""), pa.scalar(None, pa.string()), x)
                own = [pc.subtract(rows.cast(pa.int32()), 1), _columns(letters), filled(styles_).cast(pa.int32()), filled(types), values]
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                yield pa.RecordBatch.from_arrays([same(path), same(member), own[0].cast(pa.int32()), *own[1:], pa.nulls(n, pa.string())], names=names)
            if len(_ANY.findall(text)) > n:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), *(pa.nulls(1, k) for k in kinds), pa.array([_PLAIN.sub("", text) if n else text])], names=names)


_SIMPLE = ["srow", "scol", "sstyle", "st", "sv"]


@once
def _lines() -> list[Column]:
    rows = F.regexp_extract_all("rest", F.lit(r"(?s)<row(?:\s[^>]*?)?/>|<row(?:\s[^>]*)?>.*?</row>"), F.lit(0))
    return [F.col("path"), F.col("member"), *map(F.col, _SIMPLE), F.explode(F.when(F.col("rest").isNotNull(), rows).otherwise(F.array(F.lit(None).cast("string")))).alias("e")]


@once
def _line_cells() -> list[Column]:
    number = attribute(F.regexp_extract("e", r"(?s)^(<row[^>]*>)", 1), "r").try_cast("int") - 1
    cells = F.regexp_extract_all("e", F.lit(r"(?s)<c(?:\s[^>]*?)?/>|<c(?:\s[^>]*)?>.*?</c>"), F.lit(0))
    present = F.col("e").isNotNull()
    return [F.col("path"), F.col("member"), *map(F.col, _SIMPLE), F.when(present, number).alias("line"), F.explode(F.when(present, cells).otherwise(F.array(F.lit(None).cast("string")))).alias("c")]


@once
def _tags() -> list[Column]:
    calculated = F.contains("c", F.lit("<f"))
    return [F.col("path"), F.col("member"), *map(F.col, _SIMPLE), F.col("line"), F.col("c"), F.when(F.col("c").isNotNull(), F.regexp_extract("c", r"(?s)^(<c[^>]*>)", 1)).alias("head"), F.when(calculated, F.regexp_extract("c", r"(?s)(<f(?:\s[^>]*)?>)", 1)).alias("tag")]


@once
def _fields() -> list[Column]:
    """Fields of a cell: those of the usual form are there already; of the others' elements absent references have been written out."""
    value, formula, inline = (F.regexp_extract("c", rf"(?s)<{k}(?:\s[^>]*)?>(.*?)</{k}>", 1) for k in ("v", "f", "is"))
    tag, head, other = F.col("tag"), F.col("head"), F.col("c").isNotNull()
    return [
        F.col("path"), F.col("member"), F.col("line"), F.col("srow"), F.col("scol"), F.when(other, attribute(head, "r")).alias("place"), F.when(other, attribute(head, "t")).otherwise(F.col("st")).alias("t"),
        F.when(other, attribute(head, "s").try_cast("int")).otherwise(F.col("sstyle")).alias("s"), unescape(F.when(other, value).otherwise(F.col("sv"))).alias("v"),
        F.when(F.contains("c", F.lit("<is")), strings(inline)).otherwise("").alias("inline"), F.when(tag.isNotNull(), F.nullif(unescape(formula), F.lit(""))).alias("formula"),
        F.when(tag.isNotNull(), attribute(tag, "si").try_cast("int")).alias("shared_index"), F.when(tag.isNotNull(), attribute(tag, "ref")).alias("ref"),
    ]


_KEPT = ["path", "member", "t", "v", "inline", "formula", "shared_index", "ref"]


@once
def _places() -> list[Column]:
    number = F.regexp_extract("place", "^[A-Za-z]*([0-9]+)$", 1).try_cast("int")
    present = F.col("place").isNotNull()
    return [*map(F.col, _KEPT), F.col("line"), F.col("srow"), F.col("scol"), F.coalesce("s", F.lit(0)).alias("style"), F.when(present, number).alias("number"), F.when(present, refs.padded_letters(F.regexp_extract("place", "^([A-Za-z]+)[0-9]+$", 1))).alias("letters")]


@once
def _placed() -> list[Column]:
    row = F.coalesce("srow", F.when(F.col("number") > 0, F.col("number") - 1), "line")
    return [*map(F.col, _KEPT), F.col("style"), row.alias("row"), F.coalesce("scol", refs.index_of_letters(F.col("letters")).cast("int")).alias("col")]


def _parsed(chunks: DataFrame) -> DataFrame:
    """Cells of chunks, which are dealt out first. What later steps name several times is a column of an earlier one.

    A helper takes the cells of the usual form out of a chunk with one regular expression; what is left (formulas, inline texts,
    attributes in another order) is parsed by SQL functions.
    """
    ship(chunks.sparkSession)
    own = chunks.repartition("path", "member", "chunk").select("path", "member", "text").mapInArrow(_split, _SPLIT)
    return own.select(*_lines()).select(*_line_cells()).select(*_tags()).select(*_fields()).select(*_places()).select(*_placed())


@once
def _values() -> list[Column]:
    """The cell relation out of parsed cells with their string, class and sheet."""
    given, t, filled = F.col("t"), F.coalesce("t", F.lit("n")), F.col("v") != ""
    number = F.when(t == "n", F.when(F.col("v").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col("v")).try_cast("double"))
    kind = (
        F.when(t == "inlineStr", "string").when((t == "str") & (filled | F.col("formula").isNotNull()), "string").when(~filled, "empty").when(t == "s", "string").when(t == "b", "bool").when(t == "e", "error").when(t == "d", "datetime_iso")
        .when(number.isNull(), "string").otherwise(formats.number_kind(F.coalesce("class", F.lit("other")), F.lit(False)))
    )
    wrong = F.concat(F.lit("BadCell: no value of type "), t, F.lit(": "), F.col("v"))
    fault = F.when(~t.isin("inlineStr", "str", "s", "b", "e", "d", "n") & filled, wrong).when((t == "e") & filled & ~F.col("v").isin(*ERROR_CODES.values()), wrong).when((given == "n") & filled & number.isNull(), wrong)
    fault = fault.when((t == "s") & filled & F.col("text").isNull(), F.concat(F.lit("LostString: no shared string "), F.col("v")))
    text = F.when(t == "inlineStr", F.col("inline")).when(~filled, F.when(t == "str", "")).when(t == "s", F.col("text")).when((t == "n") & number.isNotNull(), None).when(t != "b", F.col("v"))
    return [
        F.col("path"), F.col("sheet"), F.col("sheet_idx").cast("int").alias("sheet_idx"), F.col("row"), F.col("col"), kind.alias("kind"), F.lit(None).cast("bigint").alias("i"), number.alias("f"), text.alias("s"), F.when((t == "b") & filled, F.col("v") != "0").alias("b"),
        F.col("is_1904"), F.col("formula"), F.col("formula_kind"), F.col("shared_index"), fault.alias("fault"),
    ]


def dimensions(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, sheet_idx, r0, c0, r1, c1) as sheets declare them; only their first chunk is inflated. Null where a sheet says nothing."""
    first = _chunks(spark, paths, last_row=-1).where("chunk = 0")
    declared = refs.dimension(attribute(F.nullif(F.regexp_extract("text", r"(?s)(<dimension\b[^>]*>)", 1), F.lit("")), "ref"))
    own = first.select("path", "member", declared.alias("d"))
    return own.join(sheets(spark, paths).select("path", "member", "sheet", "sheet_idx"), ["path", "member"]).select("path", "sheet", F.col("sheet_idx").cast("int").alias("sheet_idx"), *(F.col(f"d.{k}").cast("int").alias(k) for k in ("r0", "c0", "r1", "c1")))


def cells(spark: SparkSession, paths, only: list[str] | None = None, last_row: int | None = None, mode: str = "failfast") -> DataFrame:
    """The cell relation of all sheets of all workbooks under the paths.

    Every file is opened once: its parts are stored in the shared folder and read from there. paths may be what ``opened``
    returns, so that several relations of the same workbooks share that.
    only: names of sheets; others are not inflated. last_row (from 0): sheets are not inflated behind it.
    mode: ``failfast`` raises where a part or a cell cannot be read; ``permissive`` leaves out that cell, and of a broken part
    what follows the break (``faults.workbook_errors`` says which these are).
    """
    own = _faulted(spark, paths, only, last_row, "raise" if mode == "failfast" else "skip")
    if mode == "failfast":
        told = F.raise_error(F.regexp_replace("fault", "^\\w+: ", "")).cast("string")
        own = own.withColumn("kind", F.when(F.col("fault").isNull(), F.col("kind")).otherwise(told))
    else:
        own = own.where("fault IS NULL")
    return own.drop("fault").to(spark.createDataFrame([], CELLS).schema)


def _faulted(spark: SparkSession, paths, only: list[str] | None = None, last_row: int | None = None, broken: str = "raise") -> DataFrame:
    """The cell relation with a column ``fault``: class and text of what is wrong with a cell."""
    paths = opened(spark, paths, only, last_row, broken, _CELL_PARTS)
    own = _styled(spark, paths, only, last_row, broken)
    # cells without a shared string have keys of their own below zero, so that they are not one hot key
    own = own.withColumn("index", F.coalesce(_string_index(), -1 - F.pmod(F.xxhash64("row", "col"), F.lit(1 << 20)).cast("int")))
    return own.join(shared_strings(spark, paths, broken), ["path", "index"], "left").select(*_values())


def _string_index() -> Column:
    return F.when(F.col("t") == "s", F.col("v").try_cast("int"))


def _styled(spark: SparkSession, paths, only: list[str] | None, last_row: int | None, broken: str) -> DataFrame:
    """Parsed cells with their sheet and class."""
    own = _with_shared(_chunks(spark, paths, only, last_row, broken))
    if last_row is not None:
        own = own.where(F.col("row") <= last_row)
    named = sheets(spark, paths, broken).select("path", "member", "sheet", "sheet_idx", "is_1904")
    own = own.join(named if only is None else named.where(F.col("sheet").isin(only)), ["path", "member"])
    return own.join(styles(spark, paths, broken), ["path", "style"], "left")


def coded_cells(spark: SparkSession, paths, only: list[str] | None = None, last_row: int | None = None) -> DataFrame:
    """The cell relation with shared strings as numbers: ``string_index``, and no text; nothing of them is read.

    Rows may be filtered, joined and grouped by (path, string_index) before ``with_strings`` fetches the texts that are left.
    """
    paths = opened(spark, paths, only, last_row, "raise", _CELL_PARTS)
    own = _styled(spark, paths, only, last_row, "raise").withColumn("text", F.lit("")).select(*_values(), _string_index().alias("string_index"))
    return own.withColumn("s", F.when(F.col("string_index").isNull(), F.col("s"))).drop("fault")


def with_strings(rows: DataFrame, strings_of: DataFrame) -> DataFrame:
    """Rows (path, string_index, ...) with their texts as ``s``; strings_of: path, index, text. A number that a dictionary lacks raises."""
    known = strings_of.select("path", F.col("index").alias("string_index"), F.col("text").alias("_text"), F.lit(True).alias("_known"))
    met = rows.join(known, ["path", "string_index"], "left")
    lost = F.raise_error(F.concat(F.lit("no shared string "), F.col("string_index"))).cast("string")
    text = F.when(F.col("_known"), F.col("_text")).when(F.col("string_index").isNotNull(), lost)
    return met.withColumn("s", F.coalesce(text, F.col("s")) if "s" in rows.columns else text).drop("_text", "_known")


@once
def _derived() -> list[Column]:
    """Of a cell with a shared index and the anchors of that index: its formula, moved from the latest anchor before it."""
    place = F.struct("row", "col")
    before = F.filter("anchors", lambda a: F.struct(a.row, a.col) <= place)

    def moved(a: Column) -> Column:
        return refs.expand_formula(a.formula, (F.col("row") - a.d.r0).cast("int"), (F.col("col") - a.d.c0).cast("int"))

    text = F.when(F.col("formula").isNull(), refs.let(F.try_element_at(before, F.lit(-1)), moved))
    return [F.col("path"), F.col("member"), F.col("row"), F.col("col"), F.col("t"), F.col("style"), F.col("v"), F.col("inline"), F.coalesce("formula", text).alias("formula"), F.col("shared_index"), F.when(F.col("formula").isNotNull(), "shared").otherwise("derived").alias("formula_kind")]


def _with_shared(chunks: DataFrame) -> DataFrame:
    """Parsed cells with the texts of derived shared formulas.

    Only chunks that speak of shared formulas are parsed a second time. Anchors are few, one for each index as a
    rule: they are gathered by index and joined to the cells, none of which are sorted.
    """
    shared = _parsed(chunks.where(F.contains("text", F.lit("shared")))).where("shared_index IS NOT NULL")
    anchors = shared.where("formula IS NOT NULL AND ref IS NOT NULL").select("path", "member", "shared_index", F.struct("row", "col", "formula", refs.dimension(F.col("ref")).alias("d")).alias("a"))
    anchors = anchors.groupBy("path", "member", "shared_index").agg(F.array_sort(F.collect_list("a")).alias("anchors"))
    derived = shared.join(anchors, ["path", "member", "shared_index"], "left").select(*_derived())
    rest = _parsed(chunks).where("shared_index IS NULL").drop("ref").withColumn("formula_kind", F.when(F.col("formula").isNotNull(), "normal"))
    return rest.unionByName(derived)


def _tails(spark: SparkSession, paths) -> DataFrame:
    """What follows the cells of each sheet: (path, sheet, sheet_idx, member, text)."""
    got = inflate(spark, paths, _SHEETS, "</row>").select("path", "member", F.regexp_extract("text", r"(?s)(?:</sheetData>|<sheetData\s*/>)(.*)$", 1).alias("text")).where("text <> ''")
    return got.join(sheets(spark, paths).select("path", "member", "sheet", "sheet_idx"), ["path", "member"])


def merges(spark: SparkSession, paths) -> DataFrame:
    found = _tails(spark, paths).select("path", "sheet", "sheet_idx", F.explode(elements(F.col("text"), "mergeCell")).alias("e"))
    return found.select("path", "sheet", "sheet_idx", refs.dimension(attribute(F.col("e"), "ref")).alias("d")).select("path", "sheet", "sheet_idx", "d.*")


def hyperlinks(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, r0, c0, r1, c1, target, location, display, tooltip); links without a rectangle are left out."""
    found = _tails(spark, paths).select("path", "member", "sheet", F.explode(elements(F.col("text"), "hyperlink")).alias("e"))
    e = F.col("e")
    own = found.select("path", "member", "sheet", refs.dimension(attribute(e, "ref")).alias("d"), F.regexp_extract("e", r'\s\w+:id\s*=\s*"([^"]*)"', 1).alias("id"), *(attribute(e, k).alias(k) for k in ("location", "display", "tooltip")))
    rels = relationships(spark, paths, r"[^/]*/worksheets/_rels/[^/]*\.rels").where("type = 'hyperlink'").select("path", F.regexp_replace("member", r"_rels/([^/]*)\.rels$", "$1").alias("member"), "id", "target")
    return own.where("d IS NOT NULL").join(rels, ["path", "member", "id"], "left").select("path", "sheet", "d.*", "target", "location", "display", "tooltip")


def tables(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, name, columns, r0, c0, r1, c1): the body of each table, without header and totals rows."""
    text = _whole(spark, paths, r"[^/]*/tables/[^/]*\.xml")
    head = F.regexp_extract("text", r"(?s)(<table\b[^>]*>)", 1)
    d = refs.dimension(attribute(head, "ref"))
    count = lambda k, n: F.coalesce(attribute(head, k).try_cast("int"), F.lit(n))
    own = text.select("path", "member", attribute(head, "displayName").alias("name"), F.transform(elements(F.col("text"), "tableColumn"), lambda e: attribute(e, "name")).alias("columns"), d.alias("d"), count("headerRowCount", 1).alias("top"), count("totalsRowCount", 0).alias("foot"))
    rels = relationships(spark, paths, r"[^/]*/worksheets/_rels/[^/]*\.rels").where("type = 'table'").select("path", F.regexp_replace("member", r"_rels/([^/]*)\.rels$", "$1").alias("sheet_member"), F.col("target").alias("member"))
    placed = own.join(rels, ["path", "member"]).join(sheets(spark, paths).select("path", F.col("member").alias("sheet_member"), "sheet"), ["path", "sheet_member"])
    return placed.select("path", "sheet", "name", "columns", (F.col("d.r0") + F.col("top")).alias("r0"), F.col("d.c0").alias("c0"), (F.col("d.r1") - F.col("foot")).alias("r1"), F.col("d.c1").alias("c1"))
