"""Column expressions for A1 references, rectangles and shared formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_COLUMNS, MAX_ROWS

_CELL = r"^(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def column_name(col: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA; null from 16,384 on."""
    letter = lambda n: F.char(F.lit(65) + n.cast("int"))

    def name(n: Column) -> Column:
        two, three = n - 26, n - 702
        return (
            F.when(n < 0, None).when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
            .when(n < MAX_COLUMNS, F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
        )

    return let(col, name)


def padded_letters(name: Column) -> Column:
    """A column's letters, filled up to three by the character before A; what is no column gives that character alone."""
    return F.lpad(F.upper(F.regexp_extract(name, "^([A-Za-z]{1,3})$", 1)), 3, "@")


def index_of_letters(padded: Column) -> Column:
    """The column of padded letters, which are named several times: a column or a variable, not a long expression."""
    digit = lambda k: F.ascii(F.substring(padded, k, 1)) - 64
    index = digit(1) * 676 + digit(2) * 26 + digit(3) - 1
    return F.when(index.between(0, MAX_COLUMNS - 1), index)


def column_index(name: Column) -> Column:
    """A -> 0; letters of any case; null for what is no column."""
    return let(padded_letters(name), index_of_letters)


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_name(col), (row + 1).cast("string"))


def a1_row(ref: Column) -> Column:
    number = F.regexp_extract(ref, r"^[A-Za-z]*([0-9]+)$", 1).try_cast("long")
    return F.when(number > 0, number - 1)


def a1_col(ref: Column) -> Column:
    return column_index(F.regexp_extract(ref, r"^([A-Za-z]+)[0-9]+$", 1))


def dimension(ref: Column) -> Column:
    """Struct r0, c0, r1, c1 of ``A1:C9`` or of one cell; null for more than two parts."""
    parts = F.split(ref, ":")
    first, last = parts[0], F.element_at(parts, -1)
    return F.when(F.size(parts) <= 2, F.struct(a1_row(first).alias("r0"), a1_col(first).alias("c0"), a1_row(last).alias("r1"), a1_col(last).alias("c1")))


def area(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return (r1 - r0 + 1) * (c1 - c0 + 1)


def contains(r0: Column, c0: Column, r1: Column, c1: Column, row: Column, col: Column) -> Column:
    return row.between(r0, r1) & col.between(c0, c1)


def _parts(token: Column, pattern: str, n: int) -> Column:
    return F.array(*(F.regexp_extract(token, pattern, k + 1) for k in range(n)))


def _moved(token: Column, rows: Column, cols: Column) -> Column:
    """A cell reference moved where it is relative; null if it is none or would leave the sheet."""

    def moved(p: Column) -> Column:
        col = column_index(p[1]) + F.when(p[0] == "", cols).otherwise(0)
        row = F.when(p[3] != "", p[3]).cast("int") - 1 + F.when(p[2] == "", rows).otherwise(0)
        return let(F.struct(col.alias("c"), row.alias("r")), lambda x: F.when(x.c.between(0, MAX_COLUMNS - 1) & x.r.between(0, MAX_ROWS - 1), F.concat(p[0], column_name(x.c), p[2], (x.r + 1).cast("string"))))

    return let(_parts(token, _CELL, 4), moved)


def _moved_side(token: Column, rows: Column, cols: Column) -> Column:
    """A whole column or a whole row, as in ``E:F`` or ``$5:6``."""

    def column(p: Column) -> Column:
        return let(column_index(p[1]) + F.when(p[0] == "", cols).otherwise(0), lambda c: F.when(c.between(0, MAX_COLUMNS - 1), F.concat(p[0], column_name(c))))

    def row(p: Column) -> Column:
        return let(F.when(p[1] != "", p[1]).cast("int") - 1 + F.when(p[0] == "", rows).otherwise(0), lambda r: F.when(r.between(0, MAX_ROWS - 1), F.concat(p[0], (r + 1).cast("string"))))

    return F.coalesce(let(_parts(token, r"^(\$?)([A-Za-z]{1,3})$", 2), column), let(_parts(token, r"^(\$?)([0-9]{1,7})$", 2), row))


def expand_formula(template: Column, rows: Column, cols: Column) -> Column:
    """A shared formula's text for a cell that lies rows below and cols right of the shared range's start.

    The text is cut into quoted literals, reference-like tokens and single other characters; tokens are
    moved one by one, but for those before a parenthesis, and all is joined again.
    """
    tokens = F.regexp_extract_all(template, F.lit(r'(?s)"[^"]*"?|[A-Za-z0-9\\._$:]+|.'), F.lit(0))

    def moved(token: Column, at: Column) -> Column:
        call = F.coalesce(F.try_element_at(tokens, at + 2), F.lit("")) == "("

        def new(sides: Column) -> Column:
            one, two = F.size(sides) == 1, F.size(sides) == 2
            alike = sides[0].rlike(r"^\$?[A-Za-z]+$") == F.element_at(sides, -1).rlike(r"^\$?[A-Za-z]+$")
            cells = let(F.transform(sides, lambda s: _moved(s, rows, cols)), lambda c: F.when(one, c[0]).when(two, F.concat(c[0], F.lit(":"), c[1])))
            lines = let(F.transform(sides, lambda s: _moved_side(s, rows, cols)), lambda c: F.when(two & alike, F.concat(c[0], F.lit(":"), c[1])))
            return F.coalesce(cells, lines)

        return F.when(call, token).otherwise(F.coalesce(let(F.split(token, ":"), new), token))

    return F.array_join(F.transform(tokens, moved), "")
