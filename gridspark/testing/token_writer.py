"""A small compiler of formulas into the tokens of binary workbooks.

A formula is a number, a text, a bool, or a tuple: an operator with its operands, ("()", x), ("%", x), ("ref", row, col, relative row,
relative col), ("area", row, col, row, col), ("ref3d", sheet entry, row, col), ("area3d", entry, row, col, row, col),
("bad3d", entry), ("name", number), ("error", code), ("call", function, arguments), ("call_n", function, arguments), ("sum", x);
or bytes, which are tokens already.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

_OPERATORS = ("+", "-", "*", "/", "^", "&", "<", "<=", "=", ">", ">=", "<>", " ", ",", ":")


class Formula(NamedTuple):
    """A cell with the tokens of its formula and its cached value."""

    tokens: bytes
    value: object


def _row(n: int, dialect: str) -> bytes:
    return struct.pack("<I" if dialect == "xlsb" else "<H", n)


def _place(row: int, col: int, dialect: str, by_row: bool = False, by_col: bool = False) -> tuple[bytes, bytes]:
    flags = (by_col << 14) | (by_row << 15)
    if dialect == "biff5":
        return struct.pack("<H", row | flags), bytes([col])
    return _row(row, dialect), struct.pack("<H", col | flags)


def _entry(n: int, dialect: str) -> bytes:
    return struct.pack("<H", n) if dialect != "biff5" else bytes(10) + struct.pack("<HH", n, n)


def _text(value: str, dialect: str) -> bytes:
    raw = value.encode("utf-16-le")
    if dialect == "xlsb":
        return struct.pack("<H", len(raw) // 2) + raw
    if dialect == "biff5":
        return bytes([len(value)]) + value.encode("cp1252")
    return bytes([len(raw) // 2, 1]) + raw


def compiled(x, dialect: str) -> bytes:
    if isinstance(x, bytes):  # compiled already
        return x
    if isinstance(x, bool):
        return bytes([0x1D, x])
    if isinstance(x, int) and 0 <= x < 1 << 16:
        return b"\x1e" + struct.pack("<H", x)
    if isinstance(x, (int, float)):
        return b"\x1f" + struct.pack("<d", x)
    if isinstance(x, str):
        return b"\x17" + _text(x, dialect)
    kind, *rest = x
    operands = lambda: b"".join(compiled(y, dialect) for y in rest)
    if kind in ("+", "-") and len(rest) == 1:
        return operands() + bytes([0x12 + (kind == "-")])
    if kind in _OPERATORS:
        return operands() + bytes([3 + _OPERATORS.index(kind)])
    if kind in ("%", "()"):
        return operands() + bytes([0x14 + (kind == "()")])
    if kind == "ref":
        return b"\x44" + b"".join(_place(rest[0], rest[1], dialect, *rest[2:]))
    if kind in ("area", "area3d"):
        entry = _entry(rest.pop(0), dialect) if kind == "area3d" else b""
        (r0, c0), (r1, c1) = _place(rest[0], rest[1], dialect), _place(rest[2], rest[3], dialect)
        return (b"\x3b" if entry else b"\x25") + entry + r0 + r1 + c0 + c1
    if kind == "ref3d":
        return b"\x5a" + _entry(rest[0], dialect) + b"".join(_place(rest[1], rest[2], dialect))
    if kind == "bad3d":
        return b"\x3c" + _entry(rest[0], dialect) + b"".join(_place(0, 0, dialect))
    if kind == "name":
        return b"\x43" + (struct.pack("<H", rest[0]) + bytes(12) if dialect == "biff5" else struct.pack("<I", rest[0]))
    if kind == "error":
        return bytes([0x1C, rest[0]])
    if kind == "sum":
        return operands() + b"\x19\x10\0\0"
    number, arguments = rest
    own = b"".join(compiled(y, dialect) for y in arguments)
    return own + (b"\x41" + struct.pack("<H", number) if kind == "call" else b"\x42" + struct.pack("<BH", len(arguments), number))
