"""Tables as cell relations: a key gives the row, each column becomes a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions.cells import serial_from_datetime

_KINDS = {"int": M.INT, "bigint": M.INT, "double": M.FLOAT, "float": M.FLOAT, "string": M.STRING, "boolean": M.BOOL, "timestamp_ntz": M.DATETIME, "timestamp": M.DATETIME}
_FIELD = {M.INT: "i", M.FLOAT: "f", M.STRING: "s", M.BOOL: "b", M.DATETIME: "f"}
_TYPES = {"i": "bigint", "f": "double", "s": "string", "b": "boolean"}


def cell(value: Column, sql_type: str, col: int) -> Column:
    """Struct of one cell; null values become empty cells."""
    kind = _KINDS[sql_type]
    held = serial_from_datetime(value.cast("timestamp_ntz")) if kind == M.DATETIME else value
    fields = [F.lit(col).alias("col"), F.when(value.isNull(), M.EMPTY).otherwise(kind).alias("kind")]
    fields += [(held if _FIELD[kind] == k else F.lit(None)).cast(t).alias(k) for k, t in _TYPES.items()]
    return F.struct(*fields, F.lit(False).alias("is_1904"))


def melt(df: DataFrame, row: Column, columns: list[str] | None = None) -> DataFrame:
    """(row, col, kind, i, f, s, b, is_1904): one narrow pass, no shuffle."""
    types = dict(df.dtypes)
    own = columns or df.columns
    cells = F.array(*(cell(F.col(c), types[c], k) for k, c in enumerate(own)))
    return df.select(row.cast("int").alias("row"), F.explode(cells).alias("c")).select("row", "c.*")
