"""Formula tokens: every token of each dialect, what is broken, and workbooks with formulas and names."""

import pytest

from gridspark.functions import library
from gridspark.sources import auto, ods, tokens, xls, xlsb
from gridspark.testing import ods_writer, xls_writer, xlsb_writer
from gridspark.testing.token_writer import Formula, compiled

DIALECTS = ("xlsb", "biff8", "biff5")


def text(x, dialect, functions=None):
    data = x if isinstance(x, bytes) else compiled(x, dialect)
    return "".join(p if isinstance(p, str) else f"<{p[0]} {p[1]}>" for p in tokens.pieces(data, dialect, functions=functions))


@pytest.mark.parametrize("dialect", DIALECTS)
@pytest.mark.parametrize(
    ("x", "want"),
    [
        (7, "7"), (70_000, "70000"), (0.1, "0.1"), (1e22, "10000000000000000000000"), (1e-7, "0.0000001"), (-2.0, "-2"), ("aé", '"aé"'), ("", '""'), (True, "TRUE"), (False, "FALSE"), (("error", 0x2A), "#N/A"), (("error", 0x2B), "#GETTING_DATA"),
        (("+", ("*", 1, 2), ("()", ("-", 3, 4))), "1*2+(3-4)"), (("%", ("-", 5)), "-5%"), (("+", 5), "+5"), (("&", "a", ("<>", 1, 2)), '"a"&1<>2'), (("^", 2, 3), "2^3"), ((",", ("area", 0, 0, 1, 1), ("area", 2, 0, 3, 1)), "$A$1:$B$2,$A$3:$B$4"),
        (("ref", 9, 27), "$AB$10") , (("ref", 9, 27, True, True), "AB10"), (("ref", 9, 27, True, False), "$AB10"), (("ref", 9, 27, False, True), "AB$10"), (("area", 0, 0, 99, 3), "$A$1:$D$100"),
        (("ref3d", 2, 0, 1), "<sheet 2>!$B$1"), (("area3d", 1, 0, 1, 4, 2), "<sheet 1>!$B$1:$C$5"), (("bad3d", 1), "<sheet 1>!#REF!"), (("name", 3), "<name 3>"), (("sum", ("area", 0, 0, 1, 0)), "SUM($A$1:$A$2)"),
        (("call", 27, [1.5, 0]), "ROUND(1.5,0)"), (("call", 19, []), "PI()"), (("call_n", 4, [1, 2, 3]), "SUM(1,2,3)"), (("call_n", 4, []), "SUM()"), (("call_n", 1, [("<", 1, 2), ("call_n", 6, [1, 2]), "no"]), 'IF(1<2,MIN(1,2),"no")'),
    ],
)
def test_texts(dialect, x, want):
    assert text(x, dialect) == want


def test_tokens_of_one_dialect():
    assert text(b"\x16", "xlsb") == "" and text(b"\x1e\1\0\x16\x1e\2\0\x42\3\1\0", "biff8") == "IF(1,,2)"
    assert text(b"\x18\x19" + bytes(12), "xlsb") == "" and text(b"\x18" + bytes(5) + b"\x1d\1", "biff8") == "TRUE"
    assert text(b"\x20" + bytes(7), "biff8") == "{PtgArray}" and text(b"\x60" + bytes(14), "xlsb") == ""
    assert text(b"\x29\3\0\x1e\5\0", "xlsb") == "5" and text(b"\x29\3\0\x1e\5\0", "biff8") == "5"
    assert text(b"\x59" + bytes(6), "xlsb") == "EXTERNAL_WB_NAME" and text(b"\x39" + bytes(6), "biff8") == "[PtgNameX]" and text(b"\x39" + bytes(24), "biff5") == "[PtgNameX]"
    assert text(b"\x1e\5\0\x19\x40\0\2", "biff8") == "  5" and text(b"\x1e\5\0\x19\x40\1\1", "biff8") == "\r5" and text(b"\x1e\5\0\x19\x40\0\2", "xlsb") == "5"
    assert text(b"\x1e\5\0\x19\1\0\0\x19\2\0\0\x19\x08\0\0", "xlsb") == "5" and text(b"\x1e\5\0\x19\4\1\0" + bytes(4), "biff8") == "5"
    assert text(b"\x2a" + bytes(6), "xlsb") == text(b"\x4a" + bytes(4), "biff8") == text(b"\x6a" + bytes(3), "biff5") == text(b"\x2b" + bytes(12), "xlsb") == text(b"\x2b" + bytes(8), "biff8") == text(b"\x2b" + bytes(6), "biff5") == "#REF!"
    assert text(b"\x17\3\0abc", "biff8") == '"abc"'


@pytest.mark.parametrize(("data", "why"), [(b"", "0 operands"), (b"\x03", "operand is missing"), (b"\x1e\1", "cut off"), (b"\x1e\1\0\x1e\1\0", "2 operands"), (b"\x7f", "no token"), (b"\x1c\x99", "no error"), (b"\x41\xff\x7f", "no function"), (b"\x41\4\0", "no fixed count"), (b"\x19\0\0\0", "no attribute")])
def test_broken(data, why):
    with pytest.raises(tokens.BadFormula, match=why):
        tokens.pieces(data)
    if data:
        (own,) = tokens.rows_of(data, "biff8")
        assert own["kind"] == "error" and why in own["text"]


def test_function_index(spark):
    given = library.functions(spark.createDataFrame([(9000, "MYOWN", None), (27, "RUNDEN", 2)], "index int, name string, arguments int"))
    assert text(("call_n", 9000, [1]), "biff8", given) == "MYOWN(1)" and text(("call", 27, [1, 2]), "biff8", given) == "RUNDEN(1,2)" and given[4] == ("SUM", None)


def test_workbooks(spark, tmp_path):
    cells = lambda d: [(Formula(compiled(("+", ("ref3d", 0, 0, 0), ("ref3d", 1, 1, 1)), d), 2.0), Formula(compiled(("&", ("name", 2), ("ref3d", 9, 0, 0)), d), "text"), Formula(compiled(("name", 7), d), True), Formula(b"\x01\0\0\0\0", 1.0))]
    names = lambda d: {"One": compiled(("ref3d", 1, 4, 4), d), "Two": compiled(("area3d", 9, 0, 0, 1, 1), d)}
    xlsb_writer.write(str(tmp_path / "a.xlsb"), {"A": cells("xlsb"), "B": [(1,)]}, names=names("xlsb"), external=[1, 0, -2, -1, 7], states={"B": 1})
    xls_writer.write(str(tmp_path / "b.xls"), {"A": cells("biff8"), "B": [(1,)]}, names=names("biff8"), external=[1, 0], states={"B": 2})
    got = {(r["path"].rsplit(".", 1)[1], r["col"]): (r["formula"], r["formula_kind"], r["f"] if r["f"] is not None else r["s"] or r["b"]) for r in auto.cells(spark, str(tmp_path)).where("sheet = 'A'").collect()}
    for kind in ("xlsb", "xls"):
        assert got[kind, 0] == ("B!$A$1+A!$B$2", "normal", 2.0) and got[kind, 1] == ("Two&#REF!$A$1", "normal", "text") and got[kind, 2] == ("#REF!", "normal", True) and got[kind, 3] == (None, None, 1.0)
    assert {tuple(r)[1:] for r in xlsb.defined_names(spark, str(tmp_path / "a.xlsb")).collect()} == {("One", "A!$E$5"), ("Two", "#REF!$A$1:$B$2")} == {tuple(r)[1:] for r in xls.defined_names(spark, str(tmp_path / "b.xls")).collect()}
    assert [r["sheet"] for r in xlsb.external_sheets(spark, str(tmp_path / "a.xlsb")).orderBy("ref").collect()] == ["B", "A", "#ThisWorkbook", "#InvalidWorkSheet", "#Unknown"]
    assert {(r["path"][-4:], r["sheet"]): r["visible"] for r in auto.sheets(spark, str(tmp_path)).collect()} == {("xlsb", "A"): "visible", ("xlsb", "B"): "hidden", (".xls", "A"): "visible", (".xls", "B"): "veryHidden"}


def test_formulas_that_cannot_be_read(spark, tmp_path):
    xls_writer.write(str(tmp_path / "b.xls"), {"A": [(Formula(b"\x7f", 1.0),)]}, names={"N": b"\x7f", "E": b""})
    assert [r["formula"] for r in xls.cells(spark, str(tmp_path / "b.xls")).collect()] == ["Unrecognised formula for cell (0, 0): no token 7f"]
    assert {(r["name"], r["formula"]) for r in xls.defined_names(spark, str(tmp_path / "b.xls")).collect()} == {("N", "Unsupported: no token 7f"), ("E", "empty rgce")}
    xlsb_writer.write(str(tmp_path / "a.xlsb"), {"A": [(Formula(b"\x7f", 1.0),)]})
    assert xlsb.cells(spark, str(tmp_path / "a.xlsb")).select("f").first()["f"] == 1.0
    with pytest.raises(Exception, match="formula of cell 0, 0: no token 7f"):
        xlsb.cells(spark, str(tmp_path / "a.xlsb")).collect()


def test_older_workbooks_name_sheets_by_their_number(spark, tmp_path):
    W = xls_writer
    own = W.cell(0, 0, Formula(compiled(("+", ("ref3d", 1, 2, 3), ("name", 1)), "biff5"), 1.0), False, {})
    book = W.workbook([("A", own), ("B", b"")], W.record(0x42, b"\xe4\4") + W.name("Ren\xe9", compiled(("ref", 0, 0), "biff5"), 0x500), kind=0x500)
    (tmp_path / "o.xls").write_bytes(W.compound(book, "Book"))
    assert [r["formula"] for r in xls.cells(spark, str(tmp_path)).collect()] == ["B!$D$3+Ren\xe9"]
    assert [tuple(r)[1:] for r in xls.defined_names(spark, str(tmp_path)).collect()] == [("Ren\xe9", "$A$1")]


def test_ods_names(spark, tmp_path):
    ods_writer.write(str(tmp_path / "c.ods"), {"A": [(1,)], "B": [(2,)]}, names={"x<y": "$A.$A$1"}, hidden=("B",))
    assert [tuple(r)[1:] for r in ods.defined_names(spark, str(tmp_path)).collect()] == [("x<y", "$A.$A$1")]
    assert [(r["sheet"], r["visible"]) for r in ods.sheets(spark, str(tmp_path)).orderBy("sheet_idx").collect()] == [("A", "visible"), ("B", "hidden")]


def test_workbooks_in_a_table(spark, tmp_path):
    xls_writer.write(str(tmp_path / "b.xls"), {"A": [(5,)]})
    table = spark.createDataFrame([("some/b.xls", (tmp_path / "b.xls").read_bytes(), 1), ("some/c.xls", None, 2)], "path string, content binary, other int")
    assert [(r["path"], r["i"]) for r in auto.cells(spark, table).collect()] == [("some/b.xls", 5)]


def test_frequent_tokens_at_once_as_step_by_step():
    """What is read at once equals what is read step by step, also where it is cut off; pieces as flat columns."""
    from gridspark.sources import tokens, xlsb
    from gridspark.testing.token_writer import compiled

    x = ("+", ("()", ("*", ("ref", 70, 3, True, False), ("area", 0, 0, 9, 1))), ("&", "é\"", ("-", ("ref3d", 1, 4, 2), ("^", 2, 0.5))))
    assert tokens.number_text(100.0) == "100" and tokens.number_text(1e21) == "1" + 21 * "0" and tokens.number_text(-2.5e-7) == "-0.00000025"
    for dialect in ("xlsb", "biff8", "biff5"):
        raw = compiled(x, dialect)
        for end in range(1, len(raw) + 1):
            t = tokens.Tokens(raw[:end], dialect)
            try:
                while t.at < end:
                    t.step()
                own = t.stack[0] if len(t.stack) == 1 else None
            except tokens.BadFormula:
                own = None
            try:
                assert tokens.pieces(raw[:end], dialect) == own
            except tokens.BadFormula:
                assert own is None
    rows = [None, [], tokens.rows_of(compiled(x, "xlsb"), "xlsb"), None, [{"kind": "name", "text": None, "ref": 3}]]
    assert xlsb.pieces_array(rows).to_pylist() == rows
