"""Pictures of zipped workbooks: media as a binary column, and where on which sheet they are anchored.

A picture hangs on a chain of three relationships: sheet -> drawing, drawing -> id of an anchor's picture, id -> media member.
Each is a join on (workbook, part); media that no anchor names are an anti join.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .parts import attribute, files
from .xlsx import _whole, relationships, sheets

# Extensions of pictures.
EXTENSIONS = ("emf", "wmf", "pict", "jpeg", "jpg", "png", "dib", "gif", "tiff", "eps", "bmp", "wpg")
_ANCHOR = r"(?s)<(?:\w+:)?(twoCellAnchor|oneCellAnchor|absoluteAnchor)\b.*?</(?:\w+:)?\1>"


def media(spark: SparkSession, paths) -> DataFrame:
    """(path, member, extension, content) of pictures in xlsx, xlsb and ods packages; members in lower case."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                if content.as_buffer()[:2].to_pybytes() != b"PK":
                    continue
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for info in z.infolist():
                        member = info.filename.replace("\\", "/").lower()
                        extension = member.rpartition(".")[2]
                        if extension in EXTENSIONS and (member.startswith("pictures/") or member.split("/")[1:2] == ["media"]):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), pa.array([extension]), pa.array([z.read(info)])], names=["path", "member", "extension", "content"])

    return files(spark, paths).mapInArrow(run, "path string, member string, extension string, content binary")


def _tag(text: Column, name: str) -> Column:
    """The last element of a name, its opening tag; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)<(?:\w+:)?{name}\b[^>]*>"), F.lit(0)), F.lit(-1))


def _number(text: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract(text, rf"<(?:\w+:)?{name}>\s*(\d+)\s*<", 1).try_cast("int"), F.lit(0))


def anchors(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, row, col, name, member) of every picture on a sheet; absolute anchors are at the first cell."""
    rels = relationships(spark, paths, r".*_rels/[^/]*\.rels").select("path", F.regexp_replace("member", r"_rels/([^/]*)\.rels$", "$1").alias("source"), "id", "target", "type")
    drawings = _whole(spark, paths, r"[^/]*/drawings/[^/]*\.xml").select("path", F.col("member").alias("drawing"), F.explode(F.regexp_extract_all("text", F.lit(_ANCHOR), F.lit(0))).alias("e"))
    start = F.regexp_extract("e", r"(?s)<(?:\w+:)?from\b[^>]*>(.*?)</(?:\w+:)?from>", 1)
    own = drawings.select("path", "drawing", _number(start, "row").alias("row"), _number(start, "col").alias("col"), F.coalesce(attribute(_tag(F.col("e"), "cNvPr"), "name"), F.lit("")).alias("name"), attribute(_tag(F.col("e"), "blip"), "embed").alias("id"))
    placed = own.where("id IS NOT NULL").join(rels.where("type = 'image'").select("path", F.col("source").alias("drawing"), "id", F.col("target").alias("member")), ["path", "drawing", "id"])
    on_sheet = rels.where("type = 'drawing'").select("path", F.col("source").alias("sheet_member"), F.col("target").alias("drawing"))
    named = on_sheet.join(sheets(spark, paths).select("path", F.col("member").alias("sheet_member"), "sheet"), ["path", "sheet_member"])
    return placed.join(named, ["path", "drawing"]).select("path", "sheet", "row", "col", "name", "member")


def pictures(spark: SparkSession, paths) -> DataFrame:
    """(path, sheet, row, col, name, extension, member, content); pictures that no anchor names have an empty sheet and name.

    A picture that is anchored twice is there twice.
    """
    every, where = media(spark, paths), anchors(spark, paths)
    anchored = where.join(every, ["path", "member"]).select("path", "sheet", "row", "col", "name", "extension", "member", "content")
    return anchored.unionByName(unanchored(every, where))


def unanchored(every: DataFrame, where: DataFrame) -> DataFrame:
    rest = every.join(where.select("path", "member"), ["path", "member"], "left_anti")
    return rest.select("path", F.lit("").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("").alias("name"), "extension", "member", "content")
