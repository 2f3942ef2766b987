"""A small xlsb writer: rows of Python values."""

from __future__ import annotations

import datetime as dt
import struct
import zipfile
from collections.abc import Iterable

from .token_writer import Formula

_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def record(kind: int, body: bytes = b"") -> bytes:
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size, n = b"", len(body)
    while True:
        size += bytes([n & 0x7F | (0x80 if n > 127 else 0)])
        n >>= 7
        if not n:
            return head + size + body


def wide(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<I", len(raw) // 2) + raw


def _cell(col: int, value, is_1904: bool, strings: dict[str, int]) -> bytes:
    head = struct.pack("<II", col, 0)
    if isinstance(value, Formula):
        own, v = struct.pack("<HI", 0, len(value.tokens)) + value.tokens + bytes(4), value.value
        kind = 8 if isinstance(v, str) else 10 if isinstance(v, bool) else 9
        return record(kind, head + (wide(v) if kind == 8 else bytes([v]) if kind == 10 else struct.pack("<d", v)) + own)
    if isinstance(value, bool):
        return record(4, head + bytes([value]))
    if isinstance(value, int) and -(1 << 29) <= value < 1 << 29:
        return record(2, head + struct.pack("<I", (value << 2 | 2) & 0xFFFFFFFF))
    if isinstance(value, (int, float)):
        cents = round(value * 100)
        if cents / 100 == value and -(1 << 29) <= cents < 1 << 29 and cents % 100:
            return record(2, head + struct.pack("<I", (cents << 2 | 3) & 0xFFFFFFFF))
        return record(5, head + struct.pack("<d", value))
    if isinstance(value, dt.datetime):
        serial = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1) - 1462 * is_1904
        return record(5, struct.pack("<II", col, 1) + struct.pack("<d", serial))
    if value == "#N/A":
        return record(3, head + b"\x2a")
    return record(7, head + struct.pack("<I", strings.setdefault(value, len(strings))))


def write(path, sheets: dict[str, Iterable], is_1904: bool = False, states: dict[str, int] | None = None, names: dict[str, bytes] | None = None, external: list[int] | None = None) -> None:
    """names: name -> tokens; external: the sheets (or what is below zero) that formulas name by number."""
    strings: dict[str, int] = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.bin", "w") as f:
                f.write(record(129) + record(145))
                for r, values in enumerate(rows):
                    f.write(record(0, struct.pack("<I", r) + bytes(13)) + b"".join(_cell(c, v, is_1904, strings) for c, v in enumerate(values) if v is not None))
                f.write(record(146) + record(130))
        bundle = b"".join(record(156, struct.pack("<II", (states or {}).get(name, 0), k) + wide(f"rId{k}") + wide(name)) for k, name in enumerate(sheets, 1))
        own = record(362, struct.pack("<I", len(external)) + b"".join(struct.pack("<Iii", 0, k, k) for k in external)) if external else b""
        own += b"".join(record(39, bytes(5) + b"\xff" * 4 + wide(n) + struct.pack("<I", len(t)) + t + bytes(4)) for n, t in (names or {}).items())
        z.writestr("xl/workbook.bin", record(131) + record(153, struct.pack("<I", is_1904) + bytes(8)) + record(143) + bundle + record(144) + own + record(132))
        rels = "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.bin"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.bin.rels", f'<Relationships xmlns="{_PACKAGE}">{rels}</Relationships>')
        z.writestr("xl/styles.bin", record(278) + record(626) + record(47, bytes(16)) + record(627) + record(617) + record(47, bytes(16)) + record(47, struct.pack("<HH", 0, 22) + bytes(12)) + record(618) + record(279))
        z.writestr("xl/sharedStrings.bin", record(159, struct.pack("<II", len(strings), len(strings))) + b"".join(record(19, b"\0" + wide(s)) for s in strings) + record(160))
