"""A small xls writer: rows of Python values as BIFF8 records in a compound file."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterable

from .token_writer import Formula

_FREE, _END, _TABLE, _MOST = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 8224


def record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def begin(what: int, version: int = 0x600) -> bytes:
    return record(0x809, struct.pack("<HH", version, what) + bytes(12))


def text(value: str, size: str = "H") -> bytes:
    wide = any(ord(c) > 255 for c in value)
    raw = value.encode("utf-16-le" if wide else "latin-1")
    return struct.pack(f"<{size}B", len(raw) // (1 + wide), wide) + raw


def shared_strings(strings: Iterable[str]) -> bytes:
    """The table of strings; what is too long for a record runs on in continuations."""
    strings = list(strings)
    parts = [bytearray(struct.pack("<II", len(strings), len(strings)))]
    for s in strings:
        own = text(s)
        if len(parts[-1]) + 5 > _MOST:
            parts.append(bytearray())
        parts[-1] += own[:3]
        rest, wide = own[3:], own[2]
        while rest:
            room = (_MOST - len(parts[-1])) // 2 * 2
            parts[-1] += rest[:room]
            rest = rest[room:]
            if rest:
                parts.append(bytearray([wide]))
    return b"".join(record(0x3C if k else 0xFC, bytes(p)) for k, p in enumerate(parts))


def cell(row: int, col: int, value, is_1904: bool, strings: dict[str, int]) -> bytes:
    head = struct.pack("<HHH", row, col, isinstance(value, dt.datetime))
    if isinstance(value, Formula):
        v = value.value
        result = b"\0\0\0\0\0\0\xff\xff" if isinstance(v, str) else bytes([1, 0, v, 0, 0, 0, 0xFF, 0xFF]) if isinstance(v, bool) else struct.pack("<d", v)
        own = record(0x06, head + result + bytes(6) + struct.pack("<H", len(value.tokens)) + value.tokens)
        return own + (record(0x207, text(v)) if isinstance(v, str) else b"")
    if isinstance(value, bool):
        return record(0x205, head + bytes([value, 0]))
    if isinstance(value, int) and -(1 << 29) <= value < 1 << 29:
        return record(0x27E, head + struct.pack("<I", (value << 2 | 2) & 0xFFFFFFFF))
    if isinstance(value, (int, float)):
        return record(0x203, head + struct.pack("<d", value))
    if isinstance(value, dt.datetime):
        return record(0x203, head + struct.pack("<d", (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1) - 1462 * is_1904))
    if value == "#N/A":
        return record(0x205, head + b"\x2a\1")
    return record(0xFD, head + struct.pack("<I", strings.setdefault(value, len(strings))))


def compound(stream: bytes, name: str = "Workbook") -> bytes:
    """A compound file of one stream; short ones lie in the pool of small sectors."""
    small = len(stream) < 4096
    length = len(stream)
    pad = lambda b, n: b + bytes(-len(b) % n)
    body = pad(pad(stream, 64), 512)
    n = len(body) // 512
    minor = b"\xff" * 512
    if small:
        m = -(-length // 64)
        minor = struct.pack(f"<{m}I", *range(1, m), _END).ljust(512, b"\xff") if m else minor
    tables = 1
    while tables * 128 < n + 2 + tables:
        tables += 1
    # sectors: stream, directory, small table, table
    follow = [*range(1, n), _END][:n] + [_END, _END] + [_TABLE] * tables
    entry = lambda name, kind, first, size, child: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, _FREE, _FREE, child) + bytes(36) + struct.pack("<III", first, size, 0)
    folder = entry("Root Entry", 5, 0 if small else _END, len(body) if small else 0, 1) + entry(name, 2, 0, length, _FREE) + bytes(256)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", tables, n, 0, 4096, n + 1 if small else _END, int(small), _END, 0)
    listed = [*range(n + 2, n + 2 + tables)] + [_FREE] * (109 - tables)
    return head + struct.pack("<109I", *listed) + body + folder + minor + struct.pack(f"<{len(follow)}I", *follow).ljust(tables * 512, b"\xff")


def workbook(sheets: list[tuple[str, bytes]], globals_: bytes, states: dict[str, int] | None = None, kind: int = 0x600) -> bytes:
    """The stream of a workbook: its own records, then each sheet's."""
    name = (lambda s: text(s, "B")) if kind == 0x600 else (lambda s: bytes([len(s)]) + s.encode("cp1252"))
    entries = [(states or {}).get(n, 0) for n, _ in sheets]
    at = len(begin(5)) + len(globals_) + sum(len(record(0x85, bytes(6) + name(n))) for n, _ in sheets) + 4
    bound, bodies = b"", b""
    for (n, own), state in zip(sheets, entries):
        bound += record(0x85, struct.pack("<IBB", at + len(bodies), state, 0) + name(n))
        bodies += begin(16, kind) + own + record(0x0A)
    return begin(5, kind) + globals_ + bound + record(0x0A) + bodies


def name(label: str, tokens: bytes, kind: int = 0x600) -> bytes:
    """A defined name."""
    raw = label.encode("cp1252") if kind != 0x600 else b"\0" + label.encode("latin-1")
    return record(0x18, struct.pack("<HBBH", 0, 0, len(label), len(tokens)) + bytes(8) + raw + tokens)


def external_sheets(entries: list[int]) -> bytes:
    return record(0x17, struct.pack("<H", len(entries)) + b"".join(struct.pack("<Hhh", 0, k, k) for k in entries))


def write(path, sheets: dict[str, Iterable], is_1904: bool = False, states: dict[str, int] | None = None, names: dict[str, bytes] | None = None, external: list[int] | None = None) -> None:
    strings: dict[str, int] = {}
    made = [(name, b"".join(cell(r, c, v, is_1904, strings) for r, values in enumerate(rows) for c, v in enumerate(values) if v is not None)) for name, rows in sheets.items()]
    xfs = b"".join(record(0xE0, struct.pack("<HH", 0, fmt) + bytes(16)) for fmt in (0, 22))
    own = record(0x42, struct.pack("<H", 1200)) + record(0x22, struct.pack("<H", is_1904)) + xfs + (external_sheets(external) if external else b"")
    own += b"".join(name(n, t) for n, t in (names or {}).items()) + shared_strings(strings)
    data = compound(workbook(made, own, states))
    if hasattr(path, "write"):
        path.write(data)
        return
    with open(path, "wb") as f:
        f.write(data)
