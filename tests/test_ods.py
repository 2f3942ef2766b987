"""OpenDocument contents written by hand."""

import zipfile

from gridspark.sources import ods

HEAD = '<office:document-content xmlns:office="o" xmlns:table="t" xmlns:text="x"><office:body><office:spreadsheet>'
TAIL = "</office:spreadsheet></office:body></office:document-content>"


def book(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", HEAD + body + TAIL)
    return str(path)


def got(spark, path):
    return {(r["sheet"], r["row"], r["col"]): (r["kind"], r["s"] if r["s"] is not None else r["b"] if r["b"] is not None else r["f"]) for r in ods.cells(spark, path).collect()}


def test_kinds_repeats_and_text(spark, tmp_path):
    body = """<table:table table:name="A &amp; B"><table:table-column/>
    <table:table-row><table:table-cell office:value-type="float" office:value="1.5"><text:p>1,5</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string"><text:p>a<text:s text:c="3"/>b</text:p><text:p>c &lt; d</text:p></table:table-cell></table:table-row>
    <table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row>
    <table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="boolean" office:boolean-value="true" table:number-columns-repeated="2"/><table:covered-table-cell office:value-type="date" office:date-value="2016-10-20"/></table:table-row>
    <table:table-row table:number-rows-repeated="1048570"><table:table-cell table:number-columns-repeated="16384"/></table:table-row></table:table>
    <table:table table:name="C"><table:table-row><table:table-cell office:value-type="time" office:time-value="PT10H10M10S" table:formula="of:=[.A1]"/><table:table-cell office:value-type="string"><office:annotation><text:p>note</text:p></office:annotation><text:p>kept</text:p></table:table-cell></table:table-row></table:table>"""
    path = book(tmp_path / "b.ods", body)
    yes = ("bool", True)
    assert got(spark, path) == {
        ("A & B", 0, 0): ("float", 1.5), ("A & B", 0, 3): ("string", "a   b\nc < d"), ("A & B", 4, 0): yes, ("A & B", 4, 1): yes, ("A & B", 5, 0): yes, ("A & B", 5, 1): yes,
        ("A & B", 4, 2): ("datetime_iso", "2016-10-20"), ("A & B", 5, 2): ("datetime_iso", "2016-10-20"), ("C", 0, 0): ("duration_iso", "PT10H10M10S"), ("C", 0, 1): ("string", "kept"),
    }
    assert [(r["sheet"], r["sheet_idx"]) for r in ods.sheets(spark, path).orderBy("sheet_idx").collect()] == [("A & B", 0), ("C", 1)]
    assert ods.cells(spark, path).where("formula IS NOT NULL").first()["formula"] == "of:=[.A1]"


def test_many_chunks_and_sheets(spark, tmp_path):
    row = lambda k: f'<table:table-row><table:table-cell office:value-type="float" office:value="{k}"/><table:table-cell office:value-type="string"><text:p>{"x" * 80}{k}</text:p></table:table-cell></table:table-row>'
    body = "".join(f'<table:table table:name="s{t}">{"".join(row(k) for k in range(6000))}</table:table>' for t in range(2))
    cells = ods.cells(spark, book(tmp_path / "c.ods", body))
    assert cells.count() == 24_000 and cells.where("kind = 'float' AND f <> row").count() == 0
    assert cells.where("kind = 'string' AND s <> concat(repeat('x', 80), row)").count() == 0


def test_contents_are_cut_and_a_chunk_is_parsed_by_itself(spark, tmp_path):
    """A chunk says in which table and row it begins, also behind repeated rows; a header is read without the chunks behind it."""
    usual = '<table:table-row{}><table:table-cell office:value-type="float" office:value="{}"/><table:table-cell office:value-type="string"><text:p>' + "y &amp; z" * 20 + "</text:p></table:table-cell></table:table-row>"
    odd = '<table:table-row><table:table-cell office:value-type="float" office:value="-1" table:number-columns-repeated="2"/></table:table-row>'
    table = "".join(usual.format(' table:number-rows-repeated="3"' if k % 4 == 0 else "", k) + (odd if k % 1000 == 0 else "") for k in range(8000))
    path = book(tmp_path / "c.ods", "".join(f'<table:table table:name="{n}">{table}</table:table>' for n in ("a", "&lt;b")))
    own = ods.opened(spark, path)
    assert own.where("usual = 'content.xml'").count() > 3
    want, row = {}, 0
    for k in range(8000):
        for _ in range(3 if k % 4 == 0 else 1):
            want[row], row = float(k), row + 1
        if k % 1000 == 0:
            want[row], row = -1.0, row + 1
    cells = ods.cells(spark, own)
    for n, name in enumerate(("a", "<b")):
        assert {r["row"]: r["f"] for r in cells.where(f"sheet_idx = {n} AND sheet = '{name}' AND col = 0").collect()} == want
    assert cells.where("kind = 'string' AND s = repeat('y & z', 20)").count() == 2 * 12_000 and cells.where("kind = 'float' AND col = 1").count() == 2 * 8
    assert "Window" not in cells._jdf.queryExecution().optimizedPlan().toString()
    first = ods.cells(spark, own, last_row=2)
    assert sorted((r["sheet_idx"], r["row"], r["f"]) for r in first.where("col = 0").collect()) == [(n, k, 0.0) for n in (0, 1) for k in range(3)]
