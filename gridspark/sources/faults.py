"""What is wrong with workbooks, as a relation: a bad package, part, record or cell ends no job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xls, xlsx
from .parts import inflate


def workbook_errors(spark: SparkSession, paths, cells: bool = True) -> DataFrame:
    """(path, part, sheet, row, col, error, text): one row for each fault; error: a class of ``model``.

    Every part of every package is inflated to its end once, so that checksums are tried; nothing of it leaves the task.
    sheet: of a broken part that a sheet lies in, or of a cell. cells: whether those of xlsx are looked at, too.
    """
    none = lambda kind: F.lit(None).cast(kind)
    split = lambda c: [F.regexp_extract(c, r"^(\w+): ", 1).alias("error"), F.regexp_replace(c, r"^\w+: ", "").alias("text")]
    parts = inflate(spark, paths, ".*", broken="report").select("path", F.col("member").alias("part"), *split("text"))
    known = xlsx.sheets(spark, paths, "skip").select("path", F.col("member").alias("part"), "sheet")
    found = parts.join(known, ["path", "part"], "left").select("path", "part", "sheet", none("int").alias("row"), none("int").alias("col"), "error", "text")
    binary = xls.records(spark, paths, xls.CELL_TYPES + [xls.STRINGS, xls.SHEET], strict=False, report=True).where("type = -1")
    found = found.unionByName(binary.select("path", F.lit("").alias("part"), none("string").alias("sheet"), none("int").alias("row"), none("int").alias("col"), F.lit("BadRecord").alias("error"), "text"))
    if not cells:
        return found
    wrong = xlsx._faulted(spark, paths, broken="skip").where("fault IS NOT NULL")
    return found.unionByName(wrong.select("path", F.lit("").alias("part"), "sheet", "row", "col", *split("fault")))
