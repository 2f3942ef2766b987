"""Schema of the cell relation, kinds and limits."""

from __future__ import annotations

CELLS = (
    "path string, sheet string, sheet_idx int, row int, col int, kind string, i bigint, f double, s string, b boolean, "
    "is_1904 boolean, formula string, formula_kind string, shared_index int"
)
VALUE_COLUMNS = ["kind", "i", "f", "s", "b", "is_1904"]

EMPTY, INT, FLOAT, STRING, BOOL = "empty", "int", "float", "string", "bool"
DATETIME, TIMEDELTA, DATETIME_ISO, DURATION_ISO, ERROR = "datetime", "timedelta", "datetime_iso", "duration_iso", "error"

MAX_ROWS = 1_048_576
MAX_COLUMNS = 16_384

# Error texts of cells, and the codes that binary formats give them.
ERROR_CODES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#DATA!"}


class GridError(ValueError):
    """A workbook that cannot be read; the subclasses say why."""


class PasswordProtected(GridError):
    pass


class UnknownFormat(GridError):
    pass


class HeaderNotFound(GridError):
    pass


class BadPackage(GridError):
    """A file that is no archive, or whose directory cannot be read."""


class NoWorkbook(GridError):
    """A package without a workbook part."""


class BadPart(GridError):
    """A part that cannot be inflated, or whose checksum is wrong."""


class BadRecord(GridError):
    """A binary workbook whose sectors or records are broken."""


class BadCell(GridError):
    """A cell whose value its type does not have, or of a type that there is not."""


class LostString(GridError):
    """A cell whose shared string is not there."""
