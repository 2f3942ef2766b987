"""Round trips of what workbooks hold beside cells: pivot caches, pictures, VBA projects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..shipping import ship
from ..sources import faults, media, pivots, vba
from ..testing import parts_writer, vba_writer, xlsx_writer
from .formulas import blobs, parts_of
from .workbooks import query_of, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = query_of(QUERIES, ORACLE_SQL)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag, l_quantity, l_discount, l_orderkey % 2 = 0 AS even, l_shipmode
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'open & "new"' ELSE l_linestatus END AS l_shipmode FROM lineitem)""")
def xlsx_pivot_cache(spark, sf_dir):
    """The records behind pivot tables: values, dictionaries of texts and numbers, missing items; rows by the names of the fields."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"), F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"), (F.col("l_orderkey") % 2 == 0).alias("even"),
        F.when(F.col("l_linestatus") == "O", 'open & "new"').otherwise(F.col("l_linestatus")).alias("l_shipmode"),
    )
    fields = [(c, c in ("l_returnflag", "l_discount", "l_shipmode")) for c in df.columns]

    def make(rows: list[tuple], out: io.BytesIO) -> None:
        half = len(rows) // 2
        parts = {k: v for n, own in enumerate((rows[:half], rows[half:]), 1) for k, v in parts_writer.pivot(n, f"Pivot{n}", fields, own).items()}
        links = {"one": [("pivotTable", "../pivotTables/pivotTable1.xml")], "two": [("pivotTable", "../pivotTables/pivotTable2.xml")]}
        xlsx_writer.write(out, {"one": [(1,)], "two": [(2,)]}, links_between=links, parts=parts)

    books = blobs(parts_of(spark, df), "pivots", make)
    return pivots.pivot_rows(spark, books, df.schema).drop("path", "sheet", "pivot")


def _picture_books(spark, sf_dir):
    """A sheet for each source, on it a picture of each document's text; those of every fifth document are anchored nowhere."""
    df = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "n_chars", F.encode("text", "UTF-8").alias("content"))

    def make(rows: list[tuple], out: io.BytesIO) -> None:
        kinds, sheets, parts = ("png", "jpeg", "gif"), {}, {}
        for key, source, size, content in rows:
            member = f"Image{key}.{kinds[key % 3]}"
            parts[f"xl/media/{member}"] = bytes(content)
            own = sheets.setdefault(source, [])
            if key % 5:
                own.append((key % 1000, size % 50, f"picture <{key}>", member))
        links = {}
        for n, (source, own) in enumerate(sheets.items(), 1):
            parts |= parts_writer.drawing(n, own)
            links[source] = [("drawing", f"../drawings/drawing{n}.xml")]
        xlsx_writer.write(out, {s: [(1,)] for s in sheets}, links_between=links, parts=parts)

    return blobs(parts_of(spark, df, 2000), "pictures", make)


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'gif' END AS extension, sha256(text) AS sha256"


@query(f"SELECT coalesce(source, 'none') AS sheet, (doc_id % 1000)::INT AS row, (n_chars % 50)::INT AS col, 'picture <' || doc_id || '>' AS name, {_KIND} FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL")
def xlsx_pictures(spark, sf_dir):
    books = _picture_books(spark, sf_dir)
    return media.pictures(spark, books).where("sheet <> ''").select("sheet", "row", "col", "name", "extension", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT doc_id, {_KIND} FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def xlsx_unanchored_pictures(spark, sf_dir):
    """Media that no anchor names: an anti join."""
    books = _picture_books(spark, sf_dir)
    rest = media.unanchored(media.media(spark, books), media.anchors(spark, books))
    return rest.select(F.regexp_extract("member", r"image(\d+)\.", 1).cast("long").alias("doc_id"), "extension", F.sha2("content", 256).alias("sha256"))


def _projects(spark, sf_dir):
    """Workbooks with a module for each document, and a reference for each of their sources; every second one is a zipped workbook."""
    df = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "text")

    def make(rows: list[tuple], out: io.BytesIO) -> None:
        references = [("registered", s, f"*\\G{{1}}#2#0#C:\\lib\\{s}.dll#Library {s}") for s in sorted({s for _, s, _ in rows})]
        streams = vba_writer.project({f"Module{key}": text for key, _, text in rows}, references)
        if rows[0][0] % 2:
            out.write(vba_writer.compound({f"_VBA_PROJECT_CUR/{k}": v for k, v in streams.items()}))
            return
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/vbaProject.bin", vba_writer.compound(streams))

    return blobs(parts_of(spark, df, 2000), "projects", make)


@query("SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents WHERE text IS NOT NULL")
def vba_modules(spark, sf_dir):
    """Texts of documents as modules of VBA projects, compressed, in storages of compound files."""
    own = vba.modules(spark, _projects(spark, sf_dir))
    return own.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n"))


@query("SELECT DISTINCT coalesce(source, 'none') AS name, 'Library ' || coalesce(source, 'none') AS description, 'C:\\lib\\' || coalesce(source, 'none') || '.dll' AS location, coalesce(source, 'none') LIKE '%1%' AS missing FROM documents WHERE text IS NOT NULL")
def vba_references(spark, sf_dir):
    """Libraries that projects name, and which of them are at no known location."""
    own = vba.references(spark, _projects(spark, sf_dir)).select("name", "description", "location").distinct()
    known = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source")).distinct().where("source NOT LIKE '%1%'").select(F.concat(F.lit("C:\\lib\\"), "source", F.lit(".dll")).alias("location"), F.lit(True).alias("known"))
    return own.join(known, "location", "left").select("name", "description", "location", F.col("known").isNull().alias("missing"))


@query("""SELECT error, sheet, count(*) AS n FROM (
  SELECT DISTINCT 'BadPart' AS error, 'nation ' || c_nationkey AS sheet, c_custkey % 4 AS book FROM customer WHERE c_nationkey % 3 = 0
  UNION ALL SELECT 'BadCell', 'nation ' || c_nationkey, c_custkey FROM customer WHERE c_nationkey % 3 = 1 AND c_custkey % 10 = 0
  UNION ALL SELECT 'LostString', 'nation ' || c_nationkey, c_custkey FROM customer WHERE c_nationkey % 3 = 1 AND c_custkey % 10 = 1) GROUP BY ALL""")
def workbook_errors(spark, sf_dir):
    """Four workbooks with a sheet for each nation: some sheets cannot be inflated, in some there are cells of no type or without a string."""
    df = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("book"), "c_custkey", "c_nationkey").repartition(4, "book")

    def book_of(rows: list[tuple[int, int]]) -> bytes:
        kinds, sheets = {0: ' t="zz"', 1: ' t="s"'}, {}
        for key, nation in rows:
            own = sheets.setdefault(nation, [])
            own.append(f'<row r="{len(own) + 1}"><c r="A{len(own) + 1}"{kinds.get(key % 10, "") if nation % 3 == 1 else ""}><v>{key}</v></c></row>')
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
            z.writestr("_rels/.rels", parts_writer.relationships([("rId1", "officeDocument", "xl/workbook.xml")]))
            z.writestr("xl/workbook.xml", f'<workbook xmlns:r="x"><sheets>{"".join(f"""<sheet name="nation {n}" sheetId="{n + 1}" r:id="rId{n}"/>""" for n in sheets)}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", parts_writer.relationships([(f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml") for n in sheets]))
            for n, own in sheets.items():
                z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet><!--sheet {n}--><sheetData>{''.join(own)}</sheetData></worksheet>")
        raw = made.getvalue()
        for n in sheets:
            if n % 3 == 0:  # one byte is another than its checksum says
                raw = raw.replace(f"<!--sheet {n}-->".encode(), f"<!--sheet {n}+->".encode(), 1)
        return raw

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for r in b.to_pylist():
                books.setdefault(r["book"], []).append((r["c_custkey"], r["c_nationkey"]))
        for book, rows in books.items():
            yield pa.RecordBatch.from_arrays([pa.array([f"book-{book}.xlsx"]), pa.array([book_of(rows)])], names=["path", "content"])

    ship(spark)
    at = shared_folder(spark, "broken")
    df.mapInArrow(each, "path string, content binary").write.parquet(at)
    found = faults.workbook_errors(spark, spark.read.schema("path string, content binary").parquet(at))
    return found.groupBy("error", "sheet").agg(F.count("*").alias("n"))
