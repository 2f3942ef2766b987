"""Members of zipped workbooks as a relation of text chunks.

Inflating is the one step that Spark has no function for, so a small helper does it, streaming: it never
holds more of a member than a chunk. Members are cut behind row (or string item) ends, so that all parsing
is left to SQL functions on chunks that are dealt out evenly.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import let
from ..model import MAX_ROWS, BadPackage, BadPart, NoWorkbook
from ..shared import kept
from ..shipping import ship

CHUNK = 1 << 20
#: Chunks of a row group where they are stored, so that a reader holds few of them.
GROUP = 8
#: path, member (lower case, forward slashes), chunk, units (rows or items before the chunk), text
SCHEMA = "path string, member string, chunk int, units long, text string"
#: Usual name of the part; of an ods content the table that a chunk begins in, if any, and how many of its rows are before the chunk.
_MORE = "usual string, sheet_idx int, sheet string, line long"
#: Usual name of a part -> the end tag behind which it is cut; other parts are one chunk.
CUTS = {r"[^/]*/worksheets/[^/]*\.xml": "</row>", r"[^/]*/sharedstrings\.xml": "</si>", r"[^/]*/pivotcache/pivotcacherecords[^/]*\.xml": "</r>", r"content\.xml": "</table:table-row>"}
_TEXTS = r".*\.(?:xml|rels)"
_PREFIX = re.compile(rb"<(/?)[A-Za-z_][\w.\-]*:")
_CDATA = re.compile(rb"<!\[CDATA\[(.*?)\]\]>", re.S)
_NUMBER = re.compile(rb"&#(x[0-9A-Fa-f]+|[0-9]+);")
_HEX = re.compile(rb"_x00([0-9A-Fa-f]{2})_")
_SAFE = {"<": "&lt;", ">": "&gt;", "&": "&amp;"}


def _character(code: int) -> bytes:
    c = chr(code)
    return _SAFE.get(c, c).encode("utf-8", "surrogatepass")


def plain(xml: bytes, prefixes: bool) -> bytes:
    """XML with literal sections, character numbers and ``_x00HH_`` written out; and, if asked, without element prefixes."""
    if b"<![CDATA[" in xml:
        xml = _CDATA.sub(lambda m: m[1].replace(b"&", b"&amp;").replace(b"<", b"&lt;").replace(b">", b"&gt;"), xml)
    if b"&#" in xml:
        xml = _NUMBER.sub(lambda m: _character(int(m[1][1:], 16) if m[1][:1] == b"x" else int(m[1])), xml)
    if b"_x00" in xml:
        xml = _HEX.sub(lambda m: _character(int(m[1], 16)), xml)
    return _PREFIX.sub(rb"<\1", xml) if prefixes else xml


_ABSENT = re.compile(rb"<(?:row|c)(?![^>]*\sr\s*=)(?:\s[^>]*)?/?>")
_PLACES = re.compile(rb"<(row|c)(\s[^>]*?)?(/?)>|</row>")
_ROW = re.compile(rb"<row\s[^>]*?\br\s*=\s*[\"'](\d+)")
_REF = re.compile(rb"\sr\s*=\s*[\"']([A-Za-z]*)(\d+)")


def column_letters(col: int) -> bytes:
    name = b""
    while col >= 0:
        name, col = bytes([65 + col % 26]) + name, col // 26 - 1
    return name


class Places:
    """Writes out the references that rows and cells of a sheet lack: each goes on from the one before it."""

    def __init__(self) -> None:
        self.row = self.col = 0

    def __call__(self, xml: bytes) -> bytes:
        """A chunk that begins with a whole row or before the first one."""
        if not _ABSENT.search(xml):
            last = xml.rfind(b"<row")
            if last >= 0 and (m := _ROW.match(xml, last)):
                self.row, self.col = int(m[1]), 0
            return xml
        return _PLACES.sub(self._written, xml)

    def _written(self, m: re.Match) -> bytes:
        if not m[1]:
            self.row, self.col = self.row + 1, 0
            return m[0]
        ref = _REF.search(m[2] or b"")
        if m[1] == b"row":
            if ref:
                self.row = int(ref[2]) - 1
            own = b"" if ref else b' r="%d"' % (self.row + 1)
            if m[3]:
                self.row, self.col = self.row + 1, 0
        else:
            if ref:
                self.col = 0
                for c in ref[1].upper():
                    self.col = self.col * 26 + c - 64
                self.col -= 1
            own = b"" if ref else b' r="%s%d"' % (column_letters(self.col), self.row + 1)
            self.col += 1
        return b"<%s%s%s%s>" % (m[1], own, m[2] or b"", m[3])


#: Of an ods content: a table's start; an empty row; the tag of a row and what it holds.
_PIECE = re.compile(r"(<table:table(?:\s[^>]*)?>)|(<table:table-row(?:\s[^>]*?)?/>)|(<table:table-row(?:\s[^>]*)?>)((?:[^<]++|<(?!/table:table-row>))*+)</table:table-row>", re.A)
_REPEATED = re.compile(r"""[\s:]table:number-rows-repeated\s*=\s*(["'])\s*([+-]?\d{1,10})\s*\1""", re.A)
_TABLE_NAME = re.compile(r"""[\s:]table:name\s*=\s*(["'])(.*?)\1""", re.A | re.S)


class Tables:
    """Goes through the chunks of an ods content, or from where one of them begins: which table, and which row of it."""

    def __init__(self, index: int | None = None, sheet: str | None = None, row: int = 0) -> None:
        self.index, self.sheet, self.row = index, sheet, row

    def rows(self, text: str) -> Iterator[tuple[int, re.Match]]:
        """(how often it is repeated, piece) of the rows of tables; ``index``, ``sheet`` and ``row`` are theirs meanwhile."""
        for m in _PIECE.finditer(text):
            if m[1]:
                named = _TABLE_NAME.search(m[1])
                self.index, self.sheet, self.row = 0 if self.index is None else self.index + 1, _resolved(named[2]) or None if named else None, 0
                continue
            tag, n = m[2] or m[3], 1
            if len(tag) > len("<table:table-row/>") and (said := _REPEATED.search(tag)) and -(1 << 31) <= int(said[2]) < 1 << 31:
                n = min(int(said[2]), MAX_ROWS)
            if self.index is not None:
                yield n, m
            self.row += n


_RELATION = re.compile(rb"<(?:[\w.\-]+:)?Relationship\s[^>]*>")


def _relations(z: zipfile.ZipFile, names: dict[str, zipfile.ZipInfo], member: str) -> list[tuple[str, str]]:
    """(type, target from the package root) of a relationship part; none where the package has no such part."""
    if member not in names:
        return []
    found, base = [], re.sub(r"_rels/[^/]*$", "", member)
    for e in _RELATION.findall(z.read(names[member])):
        kind, target = (re.search(rb"\s%s\s*=\s*[\"']([^\"']*)" % k, e) for k in (b"Type", b"Target"))
        if kind and target and b"External" not in e:
            to = target[1].decode("utf-8", "replace").replace("\\", "/").lower()
            to = to[1:] if to.startswith("/") else re.sub(r"[^/]+/\.\./", "", base + to)
            found.append((kind[1].decode("utf-8", "replace").rsplit("/", 1)[-1], to))
    return found


def roles(z: zipfile.ZipFile, names: dict[str, zipfile.ZipInfo]) -> dict[str, str]:
    """Member -> the name that its part usually has, by the relationships of the package; transitional and strict ones."""
    said = {n: n for n in names}
    for kind, book in _relations(z, names, "_rels/.rels"):
        if kind != "officeDocument" or book not in names:
            continue
        head, tail = book.rpartition("/")[::2]
        rels = f"{head}/_rels/{tail}.rels".lstrip("/")
        end = ".bin" if tail.endswith(".bin") else ".xml"
        said |= {book: f"xl/workbook{end}", rels: f"xl/_rels/workbook{end}.rels"}
        for part, to in _relations(z, names, rels):
            if to in names and part in ("worksheet", "styles", "sharedStrings"):
                where, own = to.rpartition("/")[::2]
                own = own.rpartition(".")[0] + end
                said[to] = {"worksheet": f"xl/worksheets/{own}", "styles": f"xl/styles{end}", "sharedStrings": f"xl/sharedstrings{end}"}[part]
                said[f"{where}/_rels/{to.rpartition('/')[2]}.rels".lstrip("/")] = f"xl/worksheets/_rels/{own}.rels"
    return said


#: The prefix of a part's root element.
_ROOT = re.compile(rb"<([A-Za-z_][\w.\-]*):(?:worksheet|sst|workbook|styleSheet|table|Relationships|pivotTableDefinition|pivotCacheDefinition|pivotCacheRecords|wsDr)\b")


def chunks(stream, end: bytes | None, repeat: re.Pattern | None = None) -> Iterator[tuple[int, int, bytes, bool]]:
    """(number, units before, bytes, whether elements have a prefix): cut behind the end tag ``end``, under whatever prefix the
    part has; what follows the last one is the final chunk.

    A unit counts as often as ``repeat`` finds in its text. What is held is looked through once, however long a unit is.
    """
    held, number, units, prefixed = [], 0, 0, None
    while part := stream.read(CHUNK):
        if prefixed is None:
            # end tags of an ods content have their prefix, and its tables are no root elements
            root = _ROOT.search(part[:4096]) if not end or b":" not in end else None
            prefixed = bool(root)
            if root and end:
                end = b"</" + root[1] + b":" + end[2:]
        # an end tag may lie across the border of two reads
        before = held[-1][-len(end) :] if held and end else b""
        place = (before + part).rfind(end) if end else -1
        if place >= 0:
            cut = place + len(end) - len(before)
            own = b"".join([*held, part[:cut]]) if cut >= 0 else b"".join(held)[:cut]
            held = [part[cut:]] if cut >= 0 else [b"".join(held)[cut:] + part]
            yield number, units, own, prefixed
            number += 1
            units += own.count(end) + (sum(int(n) - 1 for n in repeat.findall(own)) if repeat else 0)
        else:
            held.append(part)
    yield number, units, b"".join(held), bool(prefixed)


_SHEET = re.compile(rb"<(?:[\w.\-]+:)?sheet\s[^>]*>")


def members_of(z: zipfile.ZipFile, names: dict[str, zipfile.ZipInfo], usual: dict[str, str], sheets: frozenset[str]) -> set[str]:
    """The parts of the sheets with these names, by the workbook part of the package."""
    book = next((n for n, u in usual.items() if re.fullmatch(r"[^/]*/workbook\.xml", u)), None)
    rels = next((n for n, u in usual.items() if re.fullmatch(r"[^/]*/_rels/workbook\.xml\.rels", u)), None)
    if not book or not rels:
        return set()
    value = lambda e, k: next((html.unescape(m[2].decode("utf-8", "replace")) for m in re.finditer(rb"[\s:](%s)\s*=\s*[\"']([^\"']*)" % k, e)), "")
    ids = {value(e, b"id") for e in _SHEET.findall(plain(z.read(names[book]), False)) if value(e, b"name") in sheets}
    base = re.sub(r"_rels/[^/]*$", "", rels)
    found = set()
    for e in _RELATION.findall(z.read(names[rels])):
        if value(e, b"Id") in ids:
            to = value(e, b"Target").replace("\\", "/").lower()
            found.add(to[1:] if to.startswith("/") else re.sub(r"[^/]+/\.\./", "", base + to))
    return found


def files(spark: SparkSession, paths) -> DataFrame:
    """(path, content) of the files under the paths; or of a relation that has these columns, such as workbooks in a table."""
    if isinstance(paths, DataFrame):
        return paths.select(F.col("path").cast("string").alias("path"), "content").where("content IS NOT NULL")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")


def inflate(spark: SparkSession, paths, members: str, end: str | None = None, sheets: Iterable[str] | None = None, last_row: int | None = None, broken: str = "raise") -> DataFrame:
    """Chunks of the members whose usual name matches a pattern, of all zipped workbooks under the paths; other files are passed by.

    Which part a member is, the relationships of the package say; rows and cells of sheets have all their references.
    Sheets that are not asked for by name are not inflated, and none is behind the chunk with ``last_row`` (from 0).
    A file that is named as a zipped workbook and has no workbook part raises.

    broken: what of a package or a part that cannot be read: ``raise``; ``skip`` what follows the break, so that a sheet may lack
    rows behind it; or ``report``, for one row (path, member, -1, 0, class and text of the error) for each and no chunks.
    """
    if isinstance(paths, DataFrame) and "usual" in paths.columns:  # opened already
        own = paths.where(F.col("usual").rlike(f"^(?:{members})$"))
        return own.select("path", "member", "chunk", "units", "text") if last_row is None else own.where(F.col("units") <= max(last_row, 0)).select("path", "member", "chunk", "units", "text")
    return _inflated(spark, paths, members, {members: end} if end else {}, sheets, last_row, broken).drop(*(c.split()[0] for c in _MORE.split(", ")))


def opened(spark: SparkSession, paths, sheets: Iterable[str] | None = None, last_row: int | None = None, broken: str = "raise", members: str = _TEXTS) -> DataFrame:
    """All text parts of all packages, cut as their readers want them, with the usual name of each; every file is opened once.

    Stored in the shared folder. Readers take it in place of paths.
    """
    if isinstance(paths, DataFrame) and "usual" in paths.columns:
        return paths
    return kept(_inflated(spark, paths, members, CUTS, sheets, last_row, broken), "opened", GROUP)


def _inflated(spark: SparkSession, paths, members: str, cuts: dict[str, str], sheets: Iterable[str] | None, last_row: int | None, broken: str) -> DataFrame:
    ship(spark)
    asked = None if sheets is None else frozenset(sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ends = re.compile(members), [(re.compile(k), v) for k, v in cuts.items()]
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                if content.as_buffer()[:2].to_pybytes() != b"PK":
                    continue
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                    names = {i.filename.replace("\\", "/").lower().lstrip("/"): i for i in z.infolist()}
                    usual = roles(z, names)
                    if _NAMED.search(path) and not any(_BOOK.fullmatch(u) for u in usual.values()):
                        raise NoWorkbook("no workbook in the package")
                    only = members_of(z, names, usual, asked) if asked is not None else None
                except (*_BROKEN, NoWorkbook) as e:
                    if broken == "raise":
                        raise ValueError(f"{path}: {e}") from e
                    if broken == "report":
                        yield _chunk(path, "", "", -1, 0, _said(e if isinstance(e, NoWorkbook) else BadPackage(str(e))))
                    continue
                for name, info in names.items():
                    said = usual[name]
                    if not wanted.fullmatch(said) or (only is not None and name not in only and _SHEET_PART.fullmatch(said)):
                        continue
                    end = next((v for k, v in ends if k.fullmatch(said)), None)
                    stop = end.encode() if end else None
                    place = Places() if end == "</row>" else None
                    tables = Tables() if said == "content.xml" else None
                    try:
                        with z.open(info) as f:
                            for number, units, own, prefixed in chunks(f, stop):
                                if broken == "report":
                                    continue
                                own = plain(own, prefixed and name != "content.xml")
                                text = (place(own) if place else own).decode("utf-8", "replace")
                                yield _chunk(path, name, said, number, units, text, *((tables.index, tables.sheet, tables.row) if tables else ()))
                                for _ in tables.rows(text) if tables else ():
                                    pass
                                if last_row is not None and place and place.row > last_row:
                                    break
                    except _BROKEN as e:
                        if broken == "raise":
                            raise ValueError(f"{path}: {name}: {e}") from e
                        if broken == "report":
                            yield _chunk(path, name, said, -1, 0, _said(BadPart(str(e))))

    return files(spark, paths).mapInArrow(run, f"{SCHEMA}, {_MORE}")


_SHEET_PART = re.compile(r"[^/]*/worksheets/[^/]*\.xml")
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _chunk(path: str, member: str, usual: str, number: int, units: int, text: str, index: int | None = None, sheet: str | None = None, line: int | None = None) -> pa.RecordBatch:
    own = [([path], pa.string()), ([member], pa.string()), ([number], pa.int32()), ([units], pa.int64()), ([text], pa.string()), ([usual], pa.string()), ([index], pa.int32()), ([sheet], pa.string()), ([line], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(*x) for x in own], names=[c.split()[0] for c in f"{SCHEMA}, {_MORE}".split(", ")])


_NAMED = re.compile(r"\.(?:xlsx|xlsm|xlam)$", re.I)
_BOOK = re.compile(r"[^/]*/workbook\.(?:xml|bin)")


def attribute(element, name: str):
    """An attribute's value, entities resolved; null where it is absent or empty. Prefixes are not looked at."""
    return F.nullif(unescape(F.regexp_extract(element, rf"""(?s)^<[^>]*?[\s:]{name}\s*=\s*(["'])(.*?)\1""", 2)), F.lit(""))


#: Named entities in the order in which they are resolved.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _resolved(text: str) -> str:
    for code, c in ENTITIES if "&" in text else ():
        text = text.replace(code, c)
    return text


def unescape(text):
    """Named entities resolved."""

    def resolved(x):
        for code, c in ENTITIES:
            x = F.replace(x, F.lit(code), F.lit(c))
        return x

    return let(text, lambda x: F.when(F.contains(x, F.lit("&")), resolved(x)).otherwise(x))


def elements(text, name: str):
    """All elements of a name that hold none of the same name, as texts."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}(?:\s[^>]*?)?/>|<{name}(?:\s[^>]*)?>.*?</{name}>"), F.lit(0))


def strings(item):
    """Text of a string item: its runs in a row, phonetic text left out, trimmed unless white space is preserved."""
    bare = F.regexp_replace(item, r"(?s)<rPh\b.*?</rPh>", "")
    runs = elements(bare, "t")

    def one(t):
        inner = F.regexp_extract(t, r"(?s)^<t[^>]*>(.*)</t>$", 1)
        return unescape(F.when(t.rlike(r'^<t[^>]*xml:space\s*=\s*["\']preserve'), inner).otherwise(F.regexp_replace(inner, r"^[ \t\r\n]+|[ \t\r\n]+$", "")))

    return F.array_join(F.transform(runs, one), "")
