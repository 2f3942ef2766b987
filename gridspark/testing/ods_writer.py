"""A small ods writer: rows of Python values."""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

_NS = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0"'


def _cell(value) -> str:
    if value is None:
        return "<table:table-cell/>"
    if isinstance(value, bool):
        return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(value).lower()}"/>'
    if isinstance(value, (int, float)):
        return f'<table:table-cell office:value-type="float" office:value="{value!r}"/>'
    if isinstance(value, dt.datetime):
        return f'<table:table-cell office:value-type="date" office:date-value="{value.isoformat()}"/>'
    return f'<table:table-cell office:value-type="string"><text:p>{escape(value)}</text:p></table:table-cell>'


def write(path, sheets: dict[str, Iterable], names: dict[str, str] | None = None, hidden: tuple[str, ...] = ()) -> None:
    """names: name -> address; hidden: sheets that are not shown."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet", zipfile.ZIP_STORED)
        with z.open("content.xml", "w") as f:
            styles = "".join(f'<style:style style:name="ta{k}" style:family="table"><style:table-properties table:display="{str(n not in hidden).lower()}"/></style:style>' for k, n in enumerate(sheets))
            f.write(f"<office:document-content {_NS}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet>".encode())
            for k, (name, rows) in enumerate(sheets.items()):
                f.write(f'<table:table table:name={quoteattr(name)} table:style-name="ta{k}">'.encode())
                for values in rows:
                    f.write(f"<table:table-row>{''.join(map(_cell, values))}</table:table-row>".encode())
                f.write(b"</table:table>")
            own = "".join(f'<table:named-range table:name={quoteattr(n)} table:cell-range-address={quoteattr(a)}/>' for n, a in (names or {}).items())
            f.write(f"<table:named-expressions>{own}</table:named-expressions>".encode())
            f.write(b"</office:spreadsheet></office:body></office:document-content>")
