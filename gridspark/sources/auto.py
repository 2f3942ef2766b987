"""Workbooks of any known format under some paths: what they are, and their cells together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PasswordProtected, UnknownFormat
from . import ods, xls, xlsb, xlsx
from .parts import files, inflate

#: Extension -> format; matched with its case.
EXTENSIONS = {"xls": "xls", "xla": "xls", "xlsx": "xlsx", "xlsm": "xlsx", "xlam": "xlsx", "xlsb": "xlsb", "ods": "ods"}
READABLE = ("xlsx", "xlsb", "ods", "xls")


def format_of() -> Column:
    """The format of a file (path, content): by extension, else by the first bytes and the names that a zip archive shows."""
    has = lambda text: F.contains(F.col("content"), F.lit(text))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    zipped = F.hex(F.substring("content", 1, 2)) == "504B"
    by_content = F.when(_compound(), "xls").when(zipped & has(b"xl/workbook.bin"), "xlsb").when(zipped & has(b"content.xml"), "ods").when(zipped & (has(b"/workbook.xml") | has(b"\\workbook.xml")), "xlsx")
    return F.coalesce(known[F.regexp_extract("path", r"\.([^./]*)$", 1)], by_content)


def _compound() -> Column:
    return F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1"


def detect(spark: SparkSession, paths) -> DataFrame:
    """(path, format, encrypted).

    Compound files that hold an encrypted package are protected workbooks of the zipped kinds; others say it in a record.
    """
    own = files(spark, paths)
    sealed = own.select("path", format_of().alias("format"), (_compound() & F.contains(F.col("content"), F.lit("EncryptedPackage".encode("utf-16-le")))).alias("sealed"))
    manifests = inflate(spark, paths, r"meta-inf/manifest\.xml").where(F.contains("text", F.lit("encryption-data"))).select("path", F.lit(True).alias("manifest")).distinct()
    locked = xls.protected(spark, paths).withColumn("locked", F.lit(True))
    no = F.lit(False)
    return sealed.join(manifests, "path", "left").join(locked, "path", "left").select("path", "format", (F.col("sealed") | F.coalesce("manifest", no) | F.coalesce("locked", no)).alias("encrypted"))


def _checked(spark: SparkSession, paths, mode: str) -> None:
    if mode == "failfast":
        bad = detect(spark, paths).where(F.col("encrypted") | F.col("format").isNull() | ~F.col("format").isin(*READABLE)).orderBy("path").first()
        if bad is not None:
            raise (PasswordProtected if bad["encrypted"] else UnknownFormat)(bad["path"])


def _each(spark: SparkSession, paths, mode: str, read: dict[str, Callable]) -> DataFrame:
    """The union of what each format's reader makes of the files of its format."""
    _checked(spark, paths, mode)
    own = files(spark, paths).withColumn("format", format_of())
    parts = [f(own.where(F.col("format") == kind).select("path", "content")) for kind, f in read.items()]
    return reduce(DataFrame.unionByName, parts)


def cells(spark: SparkSession, paths, mode: str = "failfast") -> DataFrame:
    """The cell relation of all workbooks; unreadable ones raise, or are passed by in mode ``permissive``.

    paths: files or folders, or a relation (path, content) of workbooks; so in ``sheets`` and ``defined_names``.
    """
    strict = mode == "failfast"
    return _each(spark, paths, mode, {"xlsx": lambda f: xlsx.cells(spark, f, mode=mode), "ods": lambda f: ods.cells(spark, f), "xlsb": lambda f: xlsb.cells(spark, f), "xls": lambda f: xls.cells(spark, f, strict=strict)})


def sheets(spark: SparkSession, paths, mode: str = "failfast") -> DataFrame:
    """(path, sheet_idx, sheet, type, visible, is_1904) of all workbooks."""
    columns = ["path", "sheet_idx", "sheet", "type", "visible", "is_1904"]
    strict = mode == "failfast"
    return _each(spark, paths, mode, {k: (lambda f, m=m, o=o: m.sheets(spark, f, **o).select(*columns)) for k, m, o in (("xlsx", xlsx, {}), ("ods", ods, {}), ("xlsb", xlsb, {}), ("xls", xls, {"strict": strict}))})


def defined_names(spark: SparkSession, paths, mode: str = "failfast") -> DataFrame:
    """(path, name, formula) of all workbooks."""
    strict = mode == "failfast"
    return _each(spark, paths, mode, {k: (lambda f, m=m, o=o: m.defined_names(spark, f, **o)) for k, m, o in (("xlsx", xlsx, {}), ("ods", ods, {}), ("xlsb", xlsb, {}), ("xls", xls, {"strict": strict}))})
