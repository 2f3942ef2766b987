"""Pivot caches of xlsx workbooks: the records that a pivot table was made from.

A cache has a definition (its fields, each with a dictionary of shared items) and records, whose items are values or numbers of
dictionary entries. Records are cut into chunks and parsed by many tasks. For typed rows a record stays one row: it meets the
dictionaries of its cache by one join on (workbook, records), and entries are looked up by their numbers. As cells, and where
dictionaries are large, an entry meets its number by a join on (workbook, definition, field, number). Fields that are calculated
or grouped have no items in records and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cells import Cell
from ..functions.refs import let
from ..operators.rows import rows_by_headers, target
from ..shared import kept
from ..shipping import ship
from .parts import ENTITIES, attribute, elements, inflate, opened
from .xlsx import _whole, relationships, sheets

_ITEMS = r"(?s)<(?:x|m|s|n|d|b|e)(?:\s[^>]*|/)?>"
_RECORDS = r"[^/]*/pivotcache/pivotcacherecords[^/]*\.xml"
#: Characters and entries (96 each) of dictionaries that a record meets as a whole; those of larger ones meet their numbers one by one.
_HELD = 1 << 16
#: What pivot tables are made of beside their records.
_PARTS = r".*\.rels|[^/]*/(?:workbook|pivottables/[^/]*|pivotcache/pivotcachedefinition[^/]*)\.xml"
#: Value columns of the cell relation without the epoch.
_VALUE = ["kind", "i", "f", "s", "b"]


def _rels(all_rels: DataFrame, kind: str, source: str, into: str) -> DataFrame:
    """(path, source, into): the links of a kind between parts."""
    return all_rels.where(F.col("type") == kind).select("path", F.regexp_replace("member", r"_rels/([^/]*)\.rels$", "$1").alias(source), F.col("target").alias(into))


def pivot_tables(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, pivot, definition, records) of every pivot table; a table without a cache has null parts."""
    rels = relationships(spark, paths, r".*_rels/[^/]*\.rels")
    heads = _whole(spark, paths, r"[^/]*/pivottables/[^/]*\.xml").select("path", F.col("member").alias("part"), attribute(F.regexp_extract("text", r"(?s)(<pivotTableDefinition\b[^>]*>)", 1), "name").alias("pivot"))
    on_sheet = sheets(spark, paths).select("path", F.col("member").alias("sheet_member"), "sheet").join(_rels(rels, "pivotTable", "sheet_member", "part"), ["path", "sheet_member"])
    named = on_sheet.join(heads, ["path", "part"])
    cached = named.join(_rels(rels, "pivotCacheDefinition", "part", "definition"), ["path", "part"], "left")
    return cached.join(_rels(rels, "pivotCacheRecords", "definition", "records"), ["path", "definition"], "left").select("path", "sheet", "pivot", "definition", "records")


def _fields(spark: SparkSession, paths) -> DataFrame:
    """(path, definition, col, field, e): the fields that records have items of."""
    text = _whole(spark, paths, r"[^/]*/pivotcache/pivotcachedefinition[^/]*\.xml")
    every = text.select("path", F.col("member").alias("definition"), F.posexplode(elements(F.col("text"), "cacheField")).alias("at", "e"))
    head = F.regexp_extract("e", r"(?s)^(<cacheField\b[^>]*>)", 1)
    own = every.withColumn("field", attribute(head, "name")).where(F.col("field").isNotNull() & attribute(head, "formula").isNull() & ~F.contains("e", F.lit("<groupItems")))
    return own.select("path", "definition", (F.row_number().over(Window.partitionBy("path", "definition").orderBy("at")) - 1).alias("col"), "field", "e")


def pivot_fields(spark: SparkSession, paths) -> DataFrame:
    """(path, definition, col, field)."""
    return _fields(spark, paths).drop("e")


def _items(texts: Column) -> Column:
    """Items as structs of tag and value; the value is null where there is none, and empty where it says nothing."""

    def one(item):
        return F.struct(F.substring(item, 2, 1).alias("tag"), F.coalesce(attribute(item, "v"), F.when(F.regexp_like(item, F.lit(r"\sv\s*=")), "")).alias("v"))

    return F.transform(texts, one)


def _value(tag: Column, v: Column) -> Column:
    """The value columns of an item as a struct. Numbers with a point are floats, others integers; what is no value of its kind is
    an error.

    By functions of arrays, as the code of many such columns in a row would be too long a method to be compiled.
    """
    whole, real = F.when((tag == "n") & ~F.contains(v, F.lit(".")), v.try_cast("bigint")), F.when((tag == "n") & F.contains(v, F.lit(".")), v.try_cast("double"))
    truth = F.when(tag == "b", F.when(v.isin("0", "false"), False).when(v.isin("1", "true"), True))
    empty = (tag == "m") | v.isNull() | ((v == "") & (tag != "s"))
    kind = F.when(tag == "e", "error").when(empty, "empty").when(tag == "s", "string").when(tag == "d", "datetime_iso")

    def made(x):
        own = F.coalesce(x.kind, F.when(x.i.isNotNull(), "int").when(x.f.isNotNull(), "float").when(x.b.isNotNull(), "bool").when(x.tag.isin("n", "b"), "error"))
        text = F.when(x.tag == "e", "#REF!").when(own == "error", "#DATA!").when(own.isin("string", "datetime_iso"), x.v)
        return F.struct(own.alias("kind"), x.i.alias("i"), x.f.alias("f"), text.alias("s"), x.b.alias("b"), F.lit(False).alias("is_1904"))

    return let(F.struct(tag.alias("tag"), v.alias("v"), kind.alias("kind"), whole.alias("i"), real.alias("f"), truth.alias("b")), made)


def _entries(e: Column) -> Column:
    """The dictionary of a field: its shared items in their order."""
    return _items(F.regexp_extract_all(F.regexp_extract(e, r"(?s)<sharedItems\b[^>]*[^/]>(.*?)</sharedItems>", 1), F.lit(_ITEMS), F.lit(0)))


def shared_items(spark: SparkSession, paths) -> DataFrame:
    """(path, definition, col, index, kind, i, f, s, b): the dictionaries of all fields."""
    items = _fields(spark, paths).select("path", "definition", "col", F.posexplode(_entries(F.col("e"))).alias("index", "item"))
    return items.withColumn("x", _value(F.col("item.tag"), F.col("item.v"))).select("path", "definition", "col", "index", *(F.col(f"x.{c}").alias(c) for c in _VALUE))


def headers(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, pivot, header_row, col, name): the fields of every pivot table, as the operators on typed rows take them."""
    tables = pivot_tables(spark, paths).select("path", "sheet", "pivot", "definition")
    return tables.join(pivot_fields(spark, paths), ["path", "definition"]).select("path", "sheet", "pivot", F.lit(0).alias("header_row"), F.col("col").cast("int").alias("col"), F.col("field").alias("name"))


#: A record's begin, or an item of the usual form; and how a record may begin otherwise.
_USUAL = re.compile(r'<([xmsndbe])(?:( v="[^"]*)")?/>|<r>')
_OTHER = re.compile(r"<r[\s/]")
#: Records, items and their values of any form.
_RECORD, _ITEM = re.compile(r"(?s)<r(?:\s[^>]*)?>.*?</r>", re.A), re.compile(_ITEMS, re.A)
_V, _SAID = re.compile(r"""(?s)^<[^>]*?[\s:]v\s*=\s*(["'])(.*?)\1""", re.A), re.compile(r"\sv\s*=", re.A)
_WHOLE, _NUMBER = re.compile(r"[+-]?\d+", re.A), re.compile(r"[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?", re.A)
_SPLIT = "path string, records string, row long, codes string, i array<bigint>, f array<double>, v array<string>"
#: What the code of an item says of it: a kind, or that it is the number of an entry (x) or counts for nothing (z).
_KINDS = {"i": "int", "f": "float", "s": "string", "d": "datetime_iso", "t": "bool", "u": "bool", "m": "empty", "e": "error", "!": "error"}


def _usual(text: str) -> tuple[str, pa.Array] | None:
    """Tags and values of a chunk's items, an r before those of each record; none where a chunk has anything of another form."""
    n, first, last = text.count("</r>"), text.find("<r>"), text.rfind("</r>")
    found = _USUAL.findall(text, first, last) if first >= 0 else []
    if not found or _OTHER.search(text, 0, first) or len(found) + n - 1 != text.count("<", first, last):
        return None
    tags, values = zip(*found)
    tags = "".join([t or "r" for t in tags])
    if tags.count("r") != n:
        return None
    values = pa.array([v for t, v in zip(tags, values) if t != "r"], pa.string())
    return tags, pc.utf8_slice_codeunits(pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values), 4)  # behind the name and the quote


def _any(text: str) -> tuple[str, pa.Array]:
    """The same of a chunk of any form."""
    tags, values = [], []
    for r in _RECORD.findall(text):
        items = _ITEM.findall(r)
        tags += ["r", *(x[1] for x in items)]
        values += [m[2] if (m := _V.search(x)) else "" if _SAID.search(x) else None for x in items]
    return "".join(tags), pa.array(values, pa.string())


def _typed(tags: bytes, values: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Codes, integers (numbers of entries, too), floats and texts of items."""
    codes = np.frombuffer(tags, np.uint8).copy()
    of = lambda letters: np.isin(codes, np.frombuffer(letters, np.uint8))
    flags = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    some = flags(pc.not_equal(values, ""))
    codes[~some & of(b"x")], codes[(~some & of(b"ndb")) | (values.is_null().to_numpy(zero_copy_only=False) & of(b"s"))] = ord("z"), ord("m")
    number, none = of(b"nx"), pa.scalar(None, pa.string())
    whole = flags(pc.match_substring_regex(values, "^-?[0-9]{1,18}$")) & number
    real = flags(pc.match_substring_regex(values, r"^-?[0-9]{1,17}\.[0-9]{1,17}(e[+-]?[0-9]{1,2})?$")) & number
    ints, floats = pc.if_else(pa.array(whole), values, none).cast(pa.int64()), pc.if_else(pa.array(real), values, none).cast(pa.float64())
    if len(odd := np.flatnonzero(number & ~whole & ~real)):
        own_ints, own_floats = ints.to_pylist(), floats.to_pylist()
        for k in odd:
            x = values[int(k)].as_py().strip()
            if _WHOLE.fullmatch(x) and -(1 << 63) <= int(x) < 1 << 63:
                own_ints[k] = int(x)
            elif _NUMBER.fullmatch(x):
                own_floats[k] = float(x)
        ints, floats = pa.array(own_ints, pa.int64()), pa.array(own_floats, pa.float64())
    short = flags(pc.and_(pc.greater_equal(ints, -(1 << 31)), pc.less(ints, 1 << 31)))
    n, b = of(b"n"), of(b"b")
    codes[of(b"x") & ~short] = ord("z")
    codes[n | b] = ord("!")
    codes[n & flags(ints.is_valid())], codes[n & flags(floats.is_valid())] = ord("i"), ord("f")
    for code, said in (("t", ("1", "true")), ("u", ("0", "false"))):
        codes[b & flags(pc.is_in(values, pa.array(said)))] = ord(code)
    return codes, ints, floats, pc.if_else(pa.array(of(b"sd")), values, none)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record, with the codes of its items as one text and their values as arrays."""
    for b in batches:
        for path, member, units, text in (tuple(x.as_py() for x in own) for own in zip(*(b.column(c) for c in ("path", "member", "units", "text")))):  # one text at a time
            tags, values = _usual(text) or _any(text)
            begins = np.flatnonzero(np.frombuffer(tags.encode(), np.uint8) == ord("r"))
            if not (n := len(begins)):
                continue
            if "&" in text:
                for code, c in ENTITIES:
                    values = pc.replace_substring(values, code, c)
            codes, *typed = _typed(tags.replace("r", "").encode(), values)
            ends = np.append(begins - np.arange(n), len(values)).astype(np.int32)
            same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32)))
            letters = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(codes))
            own = [same(path), same(member), pa.array(np.arange(units + 1, units + n + 1)), letters, *(pa.ListArray.from_arrays(pa.array(ends), x) for x in typed)]
            yield pa.RecordBatch.from_arrays(own, names=[c.split()[0] for c in _SPLIT.split(", ")])


def _records(spark: SparkSession, paths) -> DataFrame:
    """(path, records, row, codes, i, f, v): codes and values of the items of each record; rows from 1.

    A helper takes them out of chunks, which are dealt out, with one regular expression where all are of the usual form.
    """
    ship(spark)
    chunks = inflate(spark, paths, _RECORDS, "</r>").repartition("path", "member", "chunk")
    return chunks.select("path", "member", "units", "text").mapInArrow(_split, _SPLIT)


def _caches(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """(path, definition, records, on, names, entries, size): each cache with the pivot tables on it, its fields, their dictionaries
    and how large these are."""
    tables = pivot_tables(spark, parts).where("records IS NOT NULL").groupBy("path", "definition", "records").agg(F.collect_list(F.struct("sheet", "pivot")).alias("on"))
    own = _fields(spark, parts).select("path", "definition", "col", "field", _entries(F.col("e")).alias("items"))
    size = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 96 + F.coalesce(F.length(x.v), F.lit(0)))
    own = own.select("path", "definition", F.struct("col", "field", F.transform("items", lambda x: _value(x.tag, x.v)).alias("entries"), size.alias("size")).alias("x")).groupBy("path", "definition").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("x.size").alias("size"))
    own = own.select("path", "definition", F.transform("x", lambda x: x.field).alias("names"), F.transform("x", lambda x: x.entries).alias("entries"), "size")
    return tables.join(own, ["path", "definition"])


def _lost(index: Column, field: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no shared item "), index, F.lit(" of "), field))


def _plain(code: str, i: str, f: str, v: str) -> list[Column]:
    """The value columns of an item that is no number of an entry."""
    letter, none = F.col(code), F.lit(None).cast("string")
    kind = none
    for c, said in _KINDS.items():
        kind = F.when(letter == c, said).otherwise(kind)
    text = F.when(letter == "e", "#REF!").when(letter == "!", "#DATA!").otherwise(F.col(v))
    return [kind.alias("kind"), F.when(letter == "i", F.col(i)).alias("i"), F.col(f).alias("f"), text.alias("s"), F.when(letter.isin("t", "u"), letter == "t").alias("b"), F.lit(False).alias("is_1904")]


def _cells(records: DataFrame, caches: DataFrame) -> DataFrame:
    """The cells of these caches; each number meets its entry by a join."""
    fields = caches.select("path", "definition", "records", F.posexplode("names").alias("col", "field"))
    flat = records.select("path", "records", "row", "codes", F.posexplode(F.arrays_zip("i", "f", "v")).alias("col", "x")).select("path", "records", "row", "col", F.substring("codes", F.col("col") + 1, F.lit(1)).alias("code"), "x.*")
    own = flat.where("code <> 'z'").join(fields.hint("shuffle_hash"), ["path", "records", "col"]).withColumn("index", F.when(F.col("code") == "x", F.col("i").cast("int")))
    entries = caches.select("path", "definition", "records", F.posexplode("entries").alias("col", "e")).select("path", "definition", "records", "col", F.posexplode("e").alias("index", "entry"))
    met = own.join(entries.hint("merge"), ["path", "definition", "records", "col", "index"], "left")
    kind = entries.schema["entry"].dataType
    cell = F.when(F.col("code") != "x", F.struct(*_plain("code", "i", "f", "v"))).otherwise(F.coalesce("entry", _lost(F.col("index"), F.col("field")).cast(kind)))
    null = F.lit(None)
    names = fields.withColumn("x", F.struct(F.lit("string").alias("kind"), null.cast("bigint").alias("i"), null.cast("double").alias("f"), F.col("field").alias("s"), null.cast("boolean").alias("b"), F.lit(False).alias("is_1904")))
    every = met.select("path", "definition", "records", "row", "col", "field", cell.alias("x")).unionByName(names.withColumn("row", F.lit(0).cast("long")))
    tables = caches.select("path", "definition", "records", F.inline("on"))
    return every.join(tables, ["path", "definition", "records"]).select("path", "sheet", "pivot", F.col("row").cast("int").alias("row"), "col", "field", *(F.col(f"x.{c}").alias(c) for c in (*_VALUE, "is_1904")))


def pivot_cells(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, pivot, row, col, field, kind, i, f, s, b, is_1904) of the records behind every pivot table.

    Row 0 has the names of the fields, so that the operators on typed rows read a cache like a sheet. A number that its dictionary
    lacks raises.
    """
    return _cells(_records(spark, paths), kept(_caches(spark, opened(spark, paths, members=_PARTS)), "caches"))


def pivot_rows(spark: SparkSession, paths, schema: StructType, strict: bool = False) -> DataFrame:
    """(path, sheet, pivot, and the schema's columns): a typed row for each record behind every pivot table, by the names of fields.

    What ``rows_by_headers`` gives of the cells and headers; but a record is a whole row already, so that no cells are grouped.
    Only caches with large dictionaries, or with several fields of one name, go by their cells. A cache that lacks a field raises.
    """
    by, fields = ["path", "sheet", "pivot"], [f.name for f in schema]
    caches = kept(_caches(spark, opened(spark, paths, members=_PARTS)), "caches")
    records = _records(spark, paths)
    hard = (F.col("size") > _HELD) | (F.size("names") > F.size(F.array_distinct("names")))
    own = _rows(records, caches.where(~hard), schema, strict)
    rest = caches.where(hard)
    if rest.isEmpty():
        return own
    heads = rest.select("path", "names", F.inline("on")).select(*by, F.lit(0).alias("header_row"), F.posexplode("names").alias("col", "name"))
    return own.unionByName(rows_by_headers(_cells(records, rest), heads, schema, by, strict).select(*by, *fields))


def _apart(name: str) -> Column:
    """A column by a function of arrays: Spark then computes its step expression by expression, not in one method with the steps
    around it, which is too long to be compiled where many fields are typed."""
    return let(F.col(name), lambda x: x).alias(name)


def _rows(records: DataFrame, caches: DataFrame, schema: StructType, strict: bool) -> DataFrame:
    """Typed rows of records, each field's item at its place. Caches are few; the hint keeps the records from being broadcast.

    One step after another, so that what is named several times is computed once; dictionaries do not leave the join's step.
    """
    by, n = ["path", "sheet", "pivot"], range(len(schema))
    missing = F.array_except(F.array(*(F.lit(f.name) for f in schema)), F.col("names"))
    told = F.raise_error(F.concat(F.lit("no column '"), F.get(missing, F.lit(0)), F.lit("'"))).cast("int")
    places = [F.when(F.size(missing) == 0, F.array_position("names", f.name).cast("int") - 1).otherwise(told).alias(f"p{k}") for k, f in enumerate(schema)]
    own = records.join(caches.select("path", "records", "on", "entries", *places).hint("shuffle_hash"), ["path", "records"])
    place = [F.col(f"p{k}") for k in n]
    own = own.select("path", "on", "entries", *place, *(F.substring("codes", place[k] + 1, F.lit(1)).alias(f"t{k}") for k in n), *(F.get(c, place[k]).alias(f"{c}{k}") for c in "ifv" for k in n))
    kind = caches.schema["entries"].dataType.elementType.elementType
    entry = lambda k: F.get(F.get("entries", place[k]), F.col(f"i{k}").cast("int"))
    met = [F.when(F.col(f"t{k}") == "x", F.coalesce(entry(k), _lost(F.col(f"i{k}"), F.lit(f.name)).cast(kind))).alias(f"e{k}") for k, f in enumerate(schema)]
    own = own.select("path", "on", *(f"{c}{k}" for c in "tifv" for k in n), *met).where(" OR ".join(f"t{k} NOT IN ('', 'z')" for k in n))
    cell = lambda k: F.when(F.col(f"t{k}") == "x", F.col(f"e{k}")).otherwise(F.struct(*_plain(f"t{k}", f"i{k}", f"f{k}", f"v{k}")))
    own = own.select("path", F.inline("on"), *(f"{c}{k}" for c in "tifve" for k in n)).select(*map(_apart, by), *(cell(k).alias(f"c{k}") for k in n))
    return own.select(*map(_apart, by), *(target(Cell(f"c{k}"), f.dataType.simpleString(), strict).alias(f.name) for k, f in enumerate(schema)))
