"""Formula tokens of binary workbooks as text.

A formula is stored in postfix order. The helper keeps a stack of operands, each a list of pieces: texts, and numbers
that stand for something of the workbook (an entry of its external-sheet index, a defined name). Pieces leave the
helper as a column; sheets and names come to them by joins on the workbook, so a missing one is an outer join's
null and becomes ``#REF``.

Layouts follow from a few widths: a row has 4 bytes in xlsb and 2 in xls, a column 2 (1 in the older xls, whose row bears
the flags of both), a sheet 2 (14 in the older xls).
"""

from __future__ import annotations

import functools
import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.library import COMMON
from ..model import ERROR_CODES
from .parts import column_letters

#: kind: null for text, ``sheet`` or ``name`` for a number to look up.
PIECES = "array<struct<kind:string,text:string,ref:int>>"
XLSB, BIFF8, BIFF5 = "xlsb", "biff8", "biff5"
# Operators by token, from 3 on; those before and behind one operand.
_BINARY = ("+", "-", "*", "/", "^", "&", "<", "<=", "=", ">", ">=", "<>", " ", ",", ":")
_BEFORE = {0x12: "+", 0x13: "-"}
# Operand tokens of the reference class.
_ARRAY, _CALL, _CALL_N, _NAME, _REF, _AREA, _MEM_AREA, _MEM_ERROR, _MEM_NONE, _MEM_FUNC, _BAD_REF, _BAD_AREA, _REF_N, _AREA_N = 0x20, 0x21, 0x22, 0x23, 0x24, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x2B, 0x2C, 0x2D
_NAME_X, _REF_3D, _AREA_3D, _BAD_REF_3D, _BAD_AREA_3D = 0x39, 0x3A, 0x3B, 0x3C, 0x3D
_ERRORS = ERROR_CODES | {0x2B: "#GETTING_DATA"}


@functools.lru_cache(1 << 14)
def _letters(col: int) -> str:
    return column_letters(col).decode()


class BadFormula(ValueError):
    pass


def number_text(value: float) -> str:
    """A double with the fewest digits, never with an exponent."""
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "inf" if value > 0 else "-inf"
    text = repr(value)
    if "e" in text:
        text = format(Decimal(text), "f")
    return text.removesuffix(".0") if text.endswith(".0") else text


class Tokens:
    """One formula's tokens, read on from a place."""

    def __init__(self, data: bytes, dialect: str = BIFF8, codec: str = "cp1252", functions: dict | None = None) -> None:
        self.data, self.at, self.dialect, self.codec = data, 0, dialect, codec
        self.functions = COMMON if functions is None else functions
        self.row_size, self.col_size = 4 if dialect == XLSB else 2, 1 if dialect == BIFF5 else 2
        self.stack: list[list] = []

    def take(self, n: int) -> bytes:
        own = self.data[self.at : self.at + n]
        if len(own) < n:
            raise BadFormula("a token is cut off")
        self.at += n
        return own

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def push(self, *pieces) -> None:
        self.stack.append(list(pieces))

    def pop(self, n: int = 1) -> list[list]:
        if len(self.stack) < n:
            raise BadFormula("an operand is missing")
        own = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return own

    # places

    def corner(self, row: int, col: int) -> str:
        """A cell of a reference; above its number, bit 14 says that the column is relative and bit 15 that the row is."""
        if self.dialect == BIFF5:
            flags, row = row >> 14, row & 0x3FFF
        else:
            flags, col = col >> 14, col & 0x3FFF
        by_row, by_col = flags & 2, flags & 1
        return f"{'' if by_col else '$'}{_letters(col)}{'' if by_row else '$'}{row + 1}"

    def place(self, cells: int) -> str:
        rows = [self.number(self.row_size) for _ in range(cells)]
        cols = [self.number(self.col_size) for _ in range(cells)]
        return ":".join(self.corner(*x) for x in zip(rows, cols))

    def sheet(self) -> tuple[str, int]:
        if self.dialect != BIFF5:
            return "sheet", self.number(2)
        self.take(10)
        own = self.number(2)
        self.take(2)
        return "sheet", own

    # tokens

    def text(self) -> str:
        if self.dialect == XLSB:
            return self.take(2 * self.number(2)).decode("utf-16-le", "replace")
        n = self.number(1)
        if self.dialect == BIFF5:
            return self.take(n).decode(self.codec, "replace")
        return self.take(2 * n).decode("utf-16-le", "replace") if self.number(1) & 1 else self.take(n).decode("latin-1")

    def call(self, index: int, count: int | None) -> None:
        name, fixed = self.functions.get(index & 0x7FFF, (None, None))
        if name is None:
            raise BadFormula(f"no function {index & 0x7FFF}")
        if count is None and fixed is None:
            raise BadFormula(f"{name} has no fixed count of arguments")
        pieces: list = [f"{name}("]
        for k, own in enumerate(self.pop(fixed if count is None else count)):
            pieces += [",", *own] if k else own
        self.push(*pieces, ")")

    def attribute(self) -> None:
        kind = self.number(1)
        if kind & 0x04:  # a choice brings a table of jumps along
            self.take(2 * (self.number(2) + 1))
            return
        body = self.take(2)
        if kind & 0x10:
            (own,) = self.pop()
            self.push("SUM(", *own, ")")
        elif kind & 0x40 and self.dialect != XLSB:  # white space before the operand
            if not self.stack or body[0] > 6:
                raise BadFormula("white space of an unknown kind")
            self.stack[-1].insert(0, ("\r" if body[0] & 1 else " ") * body[1])
        elif not kind & 0xEB:
            raise BadFormula(f"no attribute {kind:x}")

    def step(self) -> None:
        code = self.number(1)
        kind = code if code < 0x20 else code & 0x1F | 0x20  # three classes of each operand
        wide, area = self.row_size + self.col_size, 2 * (self.row_size + self.col_size)
        if 3 <= kind < 3 + len(_BINARY):
            left, right = self.pop(2)
            self.push(*left, _BINARY[kind - 3], *right)
        elif kind in _BEFORE:
            (own,) = self.pop()
            self.push(_BEFORE[kind], *own)
        elif kind == 0x14:
            (own,) = self.pop()
            self.push(*own, "%")
        elif kind == 0x15:
            (own,) = self.pop()
            self.push("(", *own, ")")
        elif kind == 0x16:
            self.push()
        elif kind == 0x17:
            self.push('"', self.text(), '"')
        elif kind == 0x18 and self.dialect == XLSB:
            sizes = {0x19: 12, 0x1D: 4}
            own = self.number(1)
            if own not in sizes:
                raise BadFormula(f"no token 18 {own:x}")
            self.take(sizes[own])
            self.push()
        elif kind == 0x18:
            self.take(5)
        elif kind == 0x19:
            self.attribute()
        elif kind == 0x1C:
            own = self.number(1)
            if own not in _ERRORS:
                raise BadFormula(f"no error {own:x}")
            self.push(_ERRORS[own])
        elif kind == 0x1D:
            self.push("TRUE" if self.number(1) else "FALSE")
        elif kind == 0x1E:
            self.push(str(self.number(2)))
        elif kind == 0x1F:
            self.push(number_text(struct.unpack("<d", self.take(8))[0]))
        elif kind == 0x01:  # the text of a shared or array formula stands elsewhere
            self.take(4)
            self.push()
        elif kind == _ARRAY:
            self.take(14 if self.dialect == XLSB else 7)
            self.push(*([] if self.dialect == XLSB else ["{PtgArray}"]))
        elif kind == _CALL:
            self.call(self.number(2), None)
        elif kind == _CALL_N:
            count = self.number(1) & 0x7F
            self.call(self.number(2), count)
        elif kind == _NAME:
            own = self.number(4 if self.dialect != BIFF5 else 2)
            self.take(12 if self.dialect == BIFF5 else 0)
            self.push(("name", own))
        elif kind in (_REF, _REF_N):
            self.push(self.place(1))
        elif kind in (_AREA, _AREA_N):
            self.push(self.place(2))
        elif kind in (_BAD_REF, _BAD_AREA):
            self.take(wide if kind == _BAD_REF else area)
            self.push("#REF!")
        elif kind == _MEM_FUNC and self.dialect == XLSB:
            self.push(*pieces(self.take(self.number(2)), self.dialect, self.codec, self.functions))
        elif kind == _MEM_FUNC:
            self.take(2)
        elif kind in (_MEM_AREA, _MEM_ERROR, _MEM_NONE):
            self.take(6)
        elif kind == _NAME_X:
            self.take(24 if self.dialect == BIFF5 else 6)
            self.push("EXTERNAL_WB_NAME" if self.dialect == XLSB else "[PtgNameX]")
        elif kind in (_REF_3D, _AREA_3D):
            self.push(self.sheet(), "!", self.place(1 if kind == _REF_3D else 2))
        elif kind in (_BAD_REF_3D, _BAD_AREA_3D):
            own = self.sheet()
            self.take(wide if kind == _BAD_REF_3D else area)
            self.push(own, "!", "#REF!")
        else:
            raise BadFormula(f"no token {code:x}")


_DOUBLE = struct.Struct("<d")
#: A cell and a rectangle: rows, then columns.
_PLACES = {True: (struct.Struct("<IH"), struct.Struct("<IIHH")), False: (struct.Struct("<HH"), struct.Struct("<HHHH"))}


def pieces(data: bytes, dialect: str = BIFF8, codec: str = "cp1252", functions: dict | None = None) -> list:
    """Pieces of a formula's text: strings, and ("sheet" | "name", number). BadFormula where tokens leave no single operand."""
    t = Tokens(data, dialect, codec, functions)
    stack, size, (place, area) = t.stack, len(data), _PLACES[dialect == XLSB]
    while t.at < size:
        code, at = data[t.at], t.at + 1
        # the tokens that most formulas are made of, at once; all others, and those that are cut off, step by step
        if 3 <= code < 18 and len(stack) > 1:
            right = stack.pop()
            stack[-1].append(_BINARY[code - 3])
            stack[-1] += right
            t.at = at
        elif code in (0x24, 0x44, 0x64) and dialect != BIFF5 and at + place.size <= size:
            stack.append([t.corner(*place.unpack_from(data, at))])
            t.at = at + place.size
        elif code == 0x1E and at + 2 <= size:
            stack.append([str(data[at] | data[at + 1] << 8)])
            t.at = at + 2
        elif code == 0x15 and stack:
            stack[-1].insert(0, "(")
            stack[-1].append(")")
            t.at = at
        elif code == 0x17 and dialect == XLSB and at + 2 <= size and (end := at + 2 + 2 * (data[at] | data[at + 1] << 8)) <= size:
            stack.append(['"', data[at + 2 : end].decode("utf-16-le", "replace"), '"'])
            t.at = end
        elif code == 0x1F and at + 8 <= size:
            stack.append([number_text(_DOUBLE.unpack_from(data, at)[0])])
            t.at = at + 8
        elif code in (0x25, 0x45, 0x65) and dialect != BIFF5 and at + area.size <= size:
            r0, r1, c0, c1 = area.unpack_from(data, at)
            stack.append([f"{t.corner(r0, c0)}:{t.corner(r1, c1)}"])
            t.at = at + area.size
        elif code in (0x3A, 0x5A, 0x7A) and dialect != BIFF5 and at + 2 + place.size <= size:
            stack.append([("sheet", data[at] | data[at + 1] << 8), "!", t.corner(*place.unpack_from(data, at + 2))])
            t.at = at + 2 + place.size
        else:
            t.step()
    if len(t.stack) != 1:
        raise BadFormula(f"{len(t.stack)} operands are left")
    return t.stack[0]


def rows_of(data: bytes, dialect: str, codec: str = "cp1252", functions: dict | None = None) -> list[dict]:
    """The same as values of the column type ``PIECES``; texts beside each other are one. A failure is a piece of kind ``error``."""
    try:
        found = pieces(bytes(data), dialect, codec, functions) if len(data) else []
    except (BadFormula, ValueError, struct.error) as e:
        return [{"kind": "error", "text": str(e), "ref": None}]
    out: list[dict] = []
    for p in found:
        if isinstance(p, tuple):
            out.append({"kind": p[0], "text": None, "ref": p[1]})
        elif out and out[-1]["kind"] is None:
            out[-1]["text"] += p
        else:
            out.append({"kind": None, "text": p, "ref": None})
    return out


def resolved(own: Column, sheets: Column, names: Column, lost_sheet: str = "#REF", lost_name: str = "#REF!") -> Column:
    """Text of pieces, with sheets and names out of maps by number (names from 1); null for no text at all."""

    def one(p: Column) -> Column:
        sheet = F.coalesce(F.try_element_at(sheets, p["ref"]), F.lit(lost_sheet))
        return F.when(p["kind"] == "sheet", sheet).when(p["kind"] == "name", F.coalesce(F.try_element_at(names, p["ref"]), F.lit(lost_name))).otherwise(p["text"])

    return F.nullif(F.array_join(F.transform(own, one), ""), F.lit(""))


def failure(own: Column) -> Column:
    """Why tokens have no text; null where they have."""
    return F.try_element_at(F.filter(own, lambda p: p["kind"] == "error"), F.lit(1))["text"]
