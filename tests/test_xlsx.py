"""xlsx parts written by hand, with what readers meet in the wild."""

import datetime as dt
import zipfile

import pytest

from gridspark.sources import xlsx
from gridspark.testing import xlsx_writer

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def package(path, sheet, strings=None, styles=None, prefix=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("XL\\Worksheets/Sheet1.xml" if prefix == "case" else "xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="S &amp; 1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        if strings:
            z.writestr("xl/sharedStrings.xml", strings)
        if styles:
            z.writestr("xl/styles.xml", styles)
    return str(path)


def got(spark, path):
    return {(r["row"], r["col"]): (r["kind"], r["s"] if r["s"] is not None else r["b"] if r["b"] is not None else r["f"]) for r in xlsx.cells(spark, path).collect()}


def test_kinds(spark, tmp_path):
    sheet = f"""<worksheet {MAIN}><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="e"><v>#REF!</v></c><c r="D1" t="d"><v>2021-01-01</v></c><c r="E1"><v>1.5</v></c><c r="F1"><v>abc</v></c></row>
    <row r="3"><c r="A3" t="inlineStr"><is><t>x&lt;y</t></is><v>9</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v></v></c><c r="D3" s="1"><v>44197</v></c><c r="E3" s="2"><v>1.5</v></c><c r="F3" t="str"><f>A1&amp;"z"</f><v>q</v></c></row>
    </sheetData></worksheet>"""
    strings = f'<sst {MAIN}><si><r><t>a</t></r><rPh sb="0"><t>no</t></rPh><r><t xml:space="preserve"> b </t></r></si><si/><si><t> c_x000D_ &#233; </t></si></sst>'
    styles = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    cells = got(spark, package(tmp_path / "k.xlsx", sheet, strings, styles))
    assert cells == {
        (0, 0): ("string", "a b "), (0, 1): ("bool", True), (0, 2): ("error", "#REF!"), (0, 3): ("datetime_iso", "2021-01-01"), (0, 4): ("float", 1.5), (0, 5): ("string", "abc"),
        (2, 0): ("string", "x<y"), (2, 1): ("string", ""), (2, 2): ("empty", None), (2, 3): ("datetime", 44197.0), (2, 4): ("timedelta", 1.5), (2, 5): ("string", "q"),
    }


def test_absent_references_prefixes_and_literal_sections(spark, tmp_path):
    sheet = f'<x:worksheet {MAIN.replace("xmlns", "xmlns:x")}><x:sheetData><x:row><x:c><x:v>1</x:v></x:c><x:c t="inlineStr"><x:is><x:t><![CDATA[a<b]]></x:t></x:is></x:c></x:row><x:row/><x:row><x:c><x:v>2</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    cells = got(spark, package(tmp_path / "p.xlsx", sheet))
    assert cells[0, 0] == ("float", 1.0) and cells[0, 1] == ("string", "a<b")


def test_references_go_on_from_the_last_one(spark, tmp_path):
    sheet = f'<worksheet {MAIN}><sheetData><row r="5"><c r="C5"><v>1</v></c><c/><c><v>2</v></c></row><row><c><v>3</v></c></row><row/><row><c><v>4</v></c><c r="AB8"><v>5</v></c><c><v>6</v></c></row></sheetData></worksheet>'
    cells = {k: v[1] for k, v in got(spark, package(tmp_path / "r.xlsx", sheet)).items() if v[0] == "float"}
    assert cells == {(4, 2): 1, (4, 4): 2, (5, 0): 3, (7, 0): 4, (7, 27): 5, (7, 28): 6}


@pytest.mark.parametrize("cell", ['t="n"><v>abc</v>', 't="zz"><v>1</v>', 't="e"><v>#OTHER!</v>'])
def test_values_that_no_type_has(spark, tmp_path, cell):
    path = package(tmp_path / "v.xlsx", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" {cell}</c></row></sheetData></worksheet>')
    with pytest.raises(Exception, match="no value of type"):
        xlsx.cells(spark, path).collect()


def test_case_of_part_names(spark, tmp_path):
    assert got(spark, package(tmp_path / "c.xlsx", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>', prefix="case")) == {(0, 0): ("float", 7.0)}


def test_bad_string_index(spark, tmp_path):
    path = package(tmp_path / "b.xlsx", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>5</v></c></row></sheetData></worksheet>', f"<sst {MAIN}><si><t>a</t></si></sst>")
    with pytest.raises(Exception, match="no shared string 5"):
        xlsx.cells(spark, path).collect()


def test_shared_formulas_and_metadata(spark, tmp_path):
    path = str(tmp_path / "m.xlsx")
    rows = [(1, {"f": "A1+$A$1", "attrs": ' t="shared" si="3" ref="B1:B3"', "v": 1}), (2, {"attrs": ' t="shared" si="3"', "v": 2}), (dt.datetime(2024, 2, 29, 12), {"f": "A1&\"<\"", "v": "x"})]
    xlsx_writer.write(path, {"One": rows, "Two": []}, merges={"One": ["A1:B1"]}, links={"One": [("A2", "http://x.org/?a=1&b=2")]}, names={"N": "One!$A$1"}, states={"Two": "hidden"}, tables={"One": ("T", "A1:B3", ["a", "b"], 1)})
    formulas = {r["row"]: (r["formula"], r["formula_kind"], r["shared_index"]) for r in xlsx.cells(spark, path).where("formula IS NOT NULL").collect()}
    assert formulas == {0: ("A1+$A$1", "shared", 3), 1: ("A2+$A$1", "derived", 3), 2: ('A1&"<"', "normal", None)}
    assert [tuple(r)[3:] for r in xlsx.merges(spark, path).collect()] == [(0, 0, 0, 1)]
    assert xlsx.hyperlinks(spark, path).first()["target"] == "http://x.org/?a=1&b=2"
    assert xlsx.defined_names(spark, path).first()["formula"] == "One!$A$1"
    assert {r["sheet"]: r["visible"] for r in xlsx.sheets(spark, path).collect()} == {"One": "visible", "Two": "hidden"}
    table = xlsx.tables(spark, path).first()
    assert (table["r0"], table["r1"], table["columns"]) == (1, 1, ["a", "b"])
    assert xlsx.cells(spark, path).where("kind = 'datetime'").first()["f"] == 45351.5


def test_many_chunks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "big.xlsx")
    xlsx_writer.write(path, {"s": ((k, f"text {k % 1000}", k / 7) for k in range(30_000))})
    cells = xlsx.cells(spark, path)
    assert cells.count() == 90_000 and cells.where("col = 0 AND f <> row").count() == 0
    assert cells.where("col = 1 AND s <> concat('text ', row % 1000)").count() == 0
