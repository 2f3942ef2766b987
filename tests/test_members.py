"""Compound files with storages, VBA projects, pivot caches, pictures."""

import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.sources import media, pivots, vba
from gridspark.sources.compound import Compound
from gridspark.testing import parts_writer, vba_writer, xls_writer, xlsx_writer


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"abc" * 20, b"x" * 300, bytes(range(200))])), max_size=40).map(b"".join), st.sampled_from([0, 256, 4096]))
def test_containers_round_trip(data, copies):
    assert vba.inflated(vba_writer.deflated(data, copies)) == data


def test_containers_by_hand():
    assert vba.inflated(b"\1" + b"\x03\xb0" + b"\x02a" + b"\x05\x00"[:2]) == b"a" * 9  # a copy that runs into itself
    assert vba.inflated(b"\1\xff\x3f" + bytes(4096)) == bytes(4096) and vba.inflated(b"\1") == b""
    for bad, why in ((b"\2", "container"), (b"\1\0\0x", "signature"), (b"\1\x02\xb0\x01\x00\x00", "before its chunk")):
        with pytest.raises(ValueError, match=why):
            vba.inflated(bad)
    long = bytes(random.Random(1).choices(b"abcd", k=20_000))
    assert vba.inflated(vba_writer.deflated(long, 4096)) == long and len(vba_writer.deflated(long, 4096)) < 14_000


@pytest.mark.parametrize("big", [0, 5000, 9_000_000])
def test_trees_of_storages(big):
    streams = {"one": b"1", "a/two": b"22" * 100, "a/b/three": b"3" * 4096, "a/b/empty": b"", "c/big": bytes(range(250)) * (big // 250)}
    file = Compound(memoryview(vba_writer.compound(streams)))
    found = file.streams()
    assert set(found) == set(streams) and {p: file.read(*w) for p, w in found.items()} == streams


def test_projects(spark, tmp_path):
    refs = [("registered", "stdole", "*\\G{0}#2.0#0#C:\\stdole2.tlb#OLE Automation"), ("project", "Other", "*\\CC:\\other.xls"), ("control", "Forms", "*\\G{0}#2#0#C:\\FM20.DLL#Forms Library"), ("registered", "none", "")]
    texts = {"Tabelle1": "Attribute VB_Name\r\nSub A()\r\n' Ä\r\nEnd Sub\r\n", "Leer": "", "Lang": "x = x + 1\r\n" * 9000}
    own = vba_writer.project(texts, refs, "cp1252", 1252)
    with zipfile.ZipFile(tmp_path / "a.xlsm", "w") as z:
        z.writestr("xl/vbaProject.bin", vba_writer.compound(own))
    (tmp_path / "b.xls").write_bytes(vba_writer.compound({"Workbook": b"", **{f"_VBA_PROJECT_CUR/{k}": v for k, v in own.items()}}))
    xlsx_writer.write(str(tmp_path / "c.xlsx"), {"s": [(1,)]})
    xls_writer.write(str(tmp_path / "d.xls"), {"s": [(1,)]})
    for name in ("a.xlsm", "b.xls"):
        mine = vba.modules(spark, str(tmp_path)).where(f"path LIKE '%{name}'").orderBy("seq").collect()
        assert {r["name"]: r["text"] for r in mine} == texts and [r["seq"] for r in mine] == [0, 1, 2] and bytes(mine[0]["raw"]) == texts["Tabelle1"].encode("cp1252")
        got = [(r["name"], r["description"], r["location"]) for r in vba.references(spark, str(tmp_path)).where(f"path LIKE '%{name}'").orderBy("seq").collect()]
        assert got == [("stdole", "OLE Automation", "C:\\stdole2.tlb"), ("Other", "Other", "C:\\other.xls"), ("Forms", "desc", "C:\\FM20.DLL"), ("none", "none", "")]
    assert vba.modules(spark, str(tmp_path)).select("path").distinct().count() == 2
    known = spark.createDataFrame([("C:\\stdole2.tlb",), ("C:\\stdole2.tlb",)], "location string")
    assert [r["missing"] for r in vba.missing_references(spark, str(tmp_path), known).collect()] == [3, 3]
    (tmp_path / "e.xls").write_bytes(vba_writer.compound({"VBA/dir": b"\1\0\0"}))
    with pytest.raises(Exception, match="VBA project cannot be read"):
        vba.modules(spark, str(tmp_path / "e.xls")).collect()


def test_pivot_caches(spark, tmp_path):
    import datetime as dt

    rows = [("a", 1, 1.5, True, dt.date(2020, 1, 2), "x"), (None, -2, 2.0, False, None, "y&<\""), ("a", None, None, None, dt.date(2020, 1, 3), "x"), ("#REF!", 7, 1e20, True, None, "")]
    fields = [("t", False), ("i", True), ("f", False), ("b", False), ("d", True), ("s", True)]
    parts = {**parts_writer.pivot(1, "P", fields, rows), **parts_writer.pivot(2, "Q", [("only", False)], [])}
    path = str(tmp_path / "p.xlsx")
    xlsx_writer.write(path, {"A": [(1,)], "B": []}, links_between={"B": [("pivotTable", "../pivotTables/pivotTable1.xml"), ("pivotTable", "../pivotTables/pivotTable2.xml")]}, parts=parts)
    assert {(r["sheet"], r["pivot"]) for r in pivots.pivot_tables(spark, path).collect()} == {("B", "P"), ("B", "Q")}
    cells = {(r["pivot"], r["row"], r["col"]): (r["field"], r["kind"], next((r[k] for k in ("i", "f", "s", "b") if r[k] is not None), None)) for r in pivots.pivot_cells(spark, path).collect()}
    names = [f for f, _ in fields]
    assert [cells["P", 0, k][::2] for k in range(6)] == [(f, f) for f in names] and cells["Q", 0, 0] == ("only", "string", "only")
    want = [[("string", "a"), ("int", 1), ("float", 1.5), ("bool", True), ("datetime_iso", "2020-01-02"), ("string", "x")], [("empty", None), ("int", -2), ("float", 2.0), ("bool", False), ("empty", None), ("string", 'y&<"')],
            [("string", "a"), ("empty", None), ("empty", None), ("empty", None), ("datetime_iso", "2020-01-03"), ("string", "x")], [("error", "#REF!"), ("int", 7), ("error", "#DATA!"), ("bool", True), ("empty", None), ("string", "")]]
    assert [[cells["P", r, k][1:] for k in range(6)] for r in range(1, 5)] == want and len(cells) == 31
    broken = parts_writer.pivot(1, "P", fields, rows)
    broken["xl/pivotCache/pivotCacheRecords1.xml"] = broken["xl/pivotCache/pivotCacheRecords1.xml"].replace('<x v="0"/>', '<x v="99"/>', 1)
    xlsx_writer.write(path, {"A": [(1,)]}, links_between={"A": [("pivotTable", "../pivotTables/pivotTable1.xml")]}, parts=broken)
    with pytest.raises(Exception, match="no shared item 99 of i"):
        pivots.pivot_cells(spark, path).collect()


def test_pictures(spark, tmp_path):
    own = parts_writer.drawing(1, [(2, 3, "a <b>", "one.png"), (9, 0, "again", "one.png"), (1, 1, "lost", "nowhere.png")])
    own["xl/drawings/drawing1.xml"] = own["xl/drawings/drawing1.xml"].replace("</xdr:wsDr>", '<xdr:absoluteAnchor><xdr:pos x="1" y="1"/><xdr:pic><xdr:cNvPr id="9" name="abs"/><a:blip r:embed="rId0"/></xdr:pic></xdr:absoluteAnchor><xdr:twoCellAnchor><xdr:from><xdr:col>1</xdr:col><xdr:row>1</xdr:row></xdr:from><xdr:sp/></xdr:twoCellAnchor></xdr:wsDr>')
    media_parts = {"xl/media/One.PNG".replace("PNG", "png"): b"\x89PNG1", "xl/media/two.jpeg": b"two", "xl/media/note.txt": b"no picture", "docs/media.png": b"elsewhere"}
    path = str(tmp_path / "p.xlsx")
    xlsx_writer.write(path, {"A": [(1,)], "B": []}, links_between={"B": [("drawing", "../drawings/drawing1.xml")]}, parts={**own, **media_parts})
    got = sorted((r["sheet"], r["row"], r["col"], r["name"], r["extension"], bytes(r["content"])) for r in media.pictures(spark, path).collect())
    assert got == [("", 0, 0, "", "jpeg", b"two"), ("B", 0, 0, "abs", "png", b"\x89PNG1"), ("B", 2, 3, "a <b>", "png", b"\x89PNG1"), ("B", 9, 0, "again", "png", b"\x89PNG1")]
    with zipfile.ZipFile(tmp_path / "o.ods", "w") as z:
        z.writestr("Pictures/x.gif", b"gif")
    assert [(r["member"], r["extension"]) for r in media.media(spark, str(tmp_path / "o.ods")).collect()] == [("pictures/x.gif", "gif")]


def test_references_read_no_module_and_trees_are_linear(spark, tmp_path):
    import time

    own = vba_writer.project({"M": "text"}, [("registered", "L", "*\\G{1}#2#0#C:\\l.dll#Library")])
    own["VBA/m0"] = b"no container"
    (tmp_path / "r.xls").write_bytes(vba_writer.compound(own))
    assert [tuple(r)[2:] for r in vba.references(spark, str(tmp_path)).collect()] == [("L", "Library", "C:\\l.dll")]
    began = time.time()
    file = Compound(memoryview(vba_writer.compound({f"VBA/m{k}": b"x" for k in range(15_000)})))
    assert len(file.streams()) == 15_000 and time.time() - began < 10


def test_pivot_rows(spark, tmp_path):
    """Typed rows are those of the cells and headers, in all forms of items; records are read once and are not grouped."""
    from pyspark.sql.types import StructType

    from gridspark.operators.rows import rows_by_headers

    fields = [("n", True), ("t", False), ("b", False)]
    usual = [(k % 3, f"a&b{k}", k % 2 == 0) for k in range(30)] + [(None, None, None), (1, "", True)]
    odd = parts_writer.pivot(2, "Odd", fields, usual)
    records = "xl/pivotCache/pivotCacheRecords2.xml"
    odd[records] = odd[records].replace("<r>", "<r >", 3).replace('<b v="1"/>', "<b v = '1' />", 2).replace('<x v="2"/>', '<x v="2" u="1"></x>', 1).replace('<b v="0"/>', '<b v="7"/>', 1).replace('<s v="a&amp;b9"/>', "<s/>").replace("</r>", "</r>\n<!-- note -->", 4)
    odd[records] = odd[records].replace("</pivotCacheRecords>", '<r></r><r><n v="+5"/><n v="1e3"/></r><r><n v="1.50"/><n v=" 8 "/><n v="99999999999999999999"/><s v="beyond"/></r><r><x v="no"/></r></pivotCacheRecords>')
    many = [(k, "x", None) for k in range(3000)]  # a dictionary that is no part of a row
    parts = {**parts_writer.pivot(1, "Usual", fields, usual), **odd, **parts_writer.pivot(3, "Many", fields, many), **parts_writer.pivot(4, "Twice", [("n", True), ("t", False), ("b", False), ("t", True)], [(1, "a", True, "b"), (2, "d", None, None)])}
    path = str(tmp_path / "p.xlsx")
    xlsx_writer.write(path, {"A": [(1,)], "B": []}, links_between={"A": [("pivotTable", f"../pivotTables/pivotTable{k}.xml") for k in (1, 2, 3, 4)], "B": [("pivotTable", "../pivotTables/pivotTable1.xml")]}, parts=parts)
    schema, by = StructType.fromDDL("t string, n bigint, b boolean"), ["path", "sheet", "pivot"]
    cells = pivots.pivot_cells(spark, path)
    want = sorted(map(repr, map(tuple, rows_by_headers(cells, pivots.headers(spark, path), schema, by).drop("path").collect())))
    rows = pivots.pivot_rows(spark, path, schema)
    assert sorted(map(repr, map(tuple, rows.drop("path").collect()))) == want and len(want) == 2 * 32 + 34 + 3000 + 2
    own = {(r["row"], r["col"]): (r["kind"], r["i"], r["f"], r["s"]) for r in cells.where("pivot = 'Odd'").collect()}
    assert own[34, 0] == ("int", 5, None, None) and own[34, 1] == ("error", None, None, "#DATA!") and (33, 0) not in own and (36, 0) not in own and (35, 3) not in own
    assert own[35, 0] == ("float", None, 1.5, None) and own[35, 1] == ("int", 8, None, None) and own[35, 2] == ("error", None, None, "#DATA!") and own[10, 1] == ("empty", None, None, None)
    only = str(tmp_path / "usual.xlsx")
    xlsx_writer.write(only, {"A": [(1,)]}, links_between={"A": [("pivotTable", "../pivotTables/pivotTable1.xml")]}, parts=parts_writer.pivot(1, "Usual", fields, usual))
    plan = pivots.pivot_rows(spark, only, schema)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Aggregate" not in plan  # inflated and split, once each
    with pytest.raises(Exception, match="no column 'other'"):
        pivots.pivot_rows(spark, only, StructType.fromDDL("t string, other string")).collect()
