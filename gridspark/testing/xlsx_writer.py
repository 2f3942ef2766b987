"""A small xlsx writer: rows of Python values, streamed into the sheet part."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="46"/></cellXfs></styleSheet>'


def name_of(col: int) -> str:
    name, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return name


def _text(value: str) -> str:
    return escape(value).replace("\r", "_x000D_")


def _cell(row: int, col: int, value, is_1904: bool, strings: dict[str, int] | None) -> str:
    ref = f'r="{name_of(col)}{row + 1}"'
    if value is None:
        return ""
    if isinstance(value, dict):  # {"f": formula, "attrs": attributes of f, "v": value}
        return f'<c {ref}><f{value.get("attrs", "")}>{escape(value.get("f", ""))}</f><v>{value.get("v", "")}</v></c>'
    if isinstance(value, bool):
        return f'<c {ref} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {ref}><v>{value!r}</v></c>"
    if isinstance(value, dt.timedelta):
        return f'<c {ref} s="2"><v>{value / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1) - 1462 * is_1904
        return f'<c {ref} s="1"><v>{serial!r}</v></c>'
    if value.startswith("#") and value.endswith(("!", "?", "/A")):
        return f'<c {ref} t="e"><v>{value}</v></c>'
    if strings is not None:
        return f'<c {ref} t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


def write(path: str, sheets: dict[str, Iterable], *, is_1904: bool = False, shared: bool = True, first: tuple[int, int] = (0, 0), states: dict[str, str] | None = None, names: dict[str, str] | None = None, merges: dict[str, list[str]] | None = None, links: dict[str, list[tuple[str, str]]] | None = None, tables: dict[str, tuple[str, str, list[str], int]] | None = None,
          dimensions: dict[str, str] | None = None, prefix: str = "", numbered: bool = False, links_between: dict[str, list[tuple[str, str]]] | None = None, parts: dict[str, str | bytes] | None = None) -> None:
    """Write sheets (name -> rows); tables: sheet -> (name, ref, columns, totals rows); dimensions: sheet -> declared reference.

    prefix: of the elements of sheets. numbered: rows are (number, values). links_between: sheet -> (type, target) of more relationships; parts: more members.
    """
    strings: dict[str, int] | None = {} if shared else None
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        rels, entries = [], []
        for k, (name, rows) in enumerate(sheets.items(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                put = (lambda x: f.write(re.sub("<(/?)(?=[A-Za-z])", rf"<\1{prefix}:", x).encode())) if prefix else (lambda x: f.write(x.encode()))
                declared = f'<dimension ref="{dimensions[name]}"/>' if dimensions and name in dimensions else ""
                put(f'<worksheet xmlns{":" + prefix if prefix else ""}="{_MAIN}" xmlns:r="{_DOC}">{declared}<sheetData>')
                for r, values in rows if numbered else enumerate(rows, first[0]):
                    own = "".join(_cell(r, c, v, is_1904, strings) for c, v in enumerate(values, first[1]))
                    put(f'<row r="{r + 1}">{own}</row>')
                put("</sheetData>")
                own_rels = []
                if own := (merges or {}).get(name):
                    f.write(f'<mergeCells>{"".join(f"<mergeCell ref={quoteattr(m)}/>" for m in own)}</mergeCells>'.encode())
                if own := (links or {}).get(name):
                    f.write(f'<hyperlinks>{"".join(f"<hyperlink ref={quoteattr(ref)} r:id={quoteattr(f"rId{n}")}/>" for n, (ref, _) in enumerate(own))}</hyperlinks>'.encode())
                    own_rels += [f'<Relationship Id="rId{n}" Type="{_DOC}/hyperlink" Target={quoteattr(url)} TargetMode="External"/>' for n, (_, url) in enumerate(own)]
                if own := (tables or {}).get(name):
                    own_rels.append(f'<Relationship Id="rIdT" Type="{_DOC}/table" Target="../tables/table{k}.xml"/>')
                put("</worksheet>")
                own_rels += [f'<Relationship Id="rIdX{n}" Type="{_DOC}/{kind}" Target={quoteattr(to)}/>' for n, (kind, to) in enumerate((links_between or {}).get(name, []))]
            if own := (tables or {}).get(name):
                columns = "".join(f'<tableColumn id="{n}" name={quoteattr(c)}/>' for n, c in enumerate(own[2], 1))
                z.writestr(f"xl/tables/table{k}.xml", f'<table xmlns="{_MAIN}" id="{k}" displayName={quoteattr(own[0])} ref={quoteattr(own[1])} totalsRowCount="{own[3]}"><tableColumns count="{len(own[2])}">{columns}</tableColumns></table>')
            if own_rels:
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{"".join(own_rels)}</Relationships>')
            state = f' state="{states[name]}"' if states and name in states else ""
            entries.append(f'<sheet name={quoteattr(name)} sheetId="{k}"{state} r:id="rId{k}"/>')
            rels.append(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        defined = "".join(f"<definedName name={quoteattr(n)}>{escape(v)}</definedName>" for n, v in (names or {}).items())
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><workbookPr{" date1904=" + quoteattr("1") if is_1904 else ""}/><sheets>{"".join(entries)}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{"".join(rels)}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        for member, body in (parts or {}).items():
            z.writestr(member, body)
        z.writestr("xl/styles.xml", _STYLES)
        if strings:
            items = "".join(f'<si><t xml:space="preserve">{_text(s)}</t></si>' for s in strings)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{items}</sst>')
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
