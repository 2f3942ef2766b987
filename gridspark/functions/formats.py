"""Number formats: which of them show a date or a duration. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER, DATETIME, TIMEDELTA = "other", "datetime", "timedelta"
#: What stands for itself: an escaped character, or quoted text (in which escapes count too).
_LITERAL = r'(?:[\\_*].?|"(?:[\\_*].|[^"\\_*])*"?)'


def builtin_class(format_id: Column) -> Column:
    """Class of a built-in format id."""
    n = format_id.cast("int")
    return F.when(n.between(14, 22) | n.isin(45, 47), DATETIME).when(n == 46, TIMEDELTA).otherwise(OTHER)


def custom_class(code: Column) -> Column:
    """Class of a format code: what its first section shows first, a date part or an elapsed time in brackets.

    Literals go first, as one left-to-right substitution; elapsed brackets become one mark and all other
    brackets go. Behind an ``a`` only the signs of an am/pm marker tell a date.
    """
    bare = F.regexp_replace(code, rf"(?s)(\[?){_LITERAL}+", "$1\u0001")
    bare = F.regexp_replace(bare, "(?<!\\[)\u0001", "")
    first = F.regexp_extract(bare, "(?s)^([^;]*)", 1)
    first = F.regexp_replace(first, r"(?i)\[(h+|m+|s+)\]", "\u0002")
    first = F.regexp_replace(first, r"\[[^\[\]]*\]?", "")
    part = F.regexp_extract(first, "(?s)^[^aAdmhysDMHYS\u0002]*([dmhysDMHYS\u0002])", 1)
    behind = F.regexp_extract(first, "(?s)^[^aA]*[aA][^pmPM/\u0002]*([pmPM/\u0002])", 1)
    found = F.when(part != "", part).otherwise(behind)
    return F.when(found == "\u0002", TIMEDELTA).when(found != "", DATETIME).otherwise(OTHER)


def number_kind(fmt: Column, integral: Column) -> Column:
    """Kind of a numeric cell under a format class."""
    return F.when(fmt.isin(DATETIME, TIMEDELTA), fmt).when(integral, "int").otherwise("float")
