"""Typed rows from cells: header names become columns, cells are converted to the asked types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cells import Cell
from ..model import VALUE_COLUMNS, HeaderNotFound

_TARGETS = {
    "string": Cell.display, "bigint": Cell.to_long, "int": lambda c: F.when(c.to_long().between(-(1 << 31), (1 << 31) - 1), c.to_long()).cast("int"), "double": Cell.to_double,
    "boolean": Cell.to_bool, "date": Cell.as_date, "timestamp_ntz": Cell.as_datetime,
}


def target(cell: Cell, kind: str, strict: bool = False) -> Column:
    """A cell as a type; empty cells and what does not convert are null, or raise when strict."""
    value = F.when(cell.kind.isNull() | (cell.is_empty() & (kind != "boolean")), None).otherwise(_TARGETS[kind](cell))
    if not strict:
        return value
    wrong = ~cell.is_empty() & value.isNull() & cell.kind.isNotNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"no {kind}: "), cell.display())).cast(kind)).otherwise(value)


def header_names(cells: DataFrame, row: int | None = None) -> dict[str, int]:
    """Trimmed header text -> column, the first of equal ones; a header row is at most as wide as a sheet."""
    first = cells.agg(F.min("row")).first()[0] if row is None else row
    found = cells.where(F.col("row") == first).select("col", F.trim(Cell().display()).alias("name")).orderBy("col").collect() if first is not None else []
    names: dict[str, int] = {}
    for r in found:
        names.setdefault(r["name"], r["col"])
    return names


def typed_rows(cells: DataFrame, schema: StructType, columns: dict[str, int], first_row: int, by: list[str] = (), strict: bool = False) -> DataFrame:
    """A row for each sheet row from first_row on; columns: field name -> sheet column.

    One grouping by row picks each field's cell; no pivot over values and no join per column.
    """
    missing = [f.name for f in schema if f.name not in columns]
    if missing:
        raise HeaderNotFound(f"no column {missing[0]!r}")
    held = cells.where((F.col("row") >= first_row) & F.col("col").isin([columns[f.name] for f in schema]))
    cell = F.struct(*VALUE_COLUMNS)
    picked = held.groupBy(*by, "row").agg(*(F.max(F.when(F.col("col") == columns[f.name], cell)).alias(f"__{k}") for k, f in enumerate(schema)))
    return picked.select(*by, *(target(Cell(f"__{k}"), f.dataType.simpleString(), strict).alias(f.name) for k, f in enumerate(schema)))


def header_relation(cells: DataFrame, by: list[str], row: int | None = None) -> DataFrame:
    """(by, header_row, col, name): the trimmed texts of each range's header row, the first of equal ones; row: its number, or null for the first row that has cells."""
    own = cells.where(F.col("kind") != "empty")
    if row is None:
        first = own.groupBy(*by, "row").agg(F.collect_list(F.struct("col", F.trim(Cell().display()).alias("name"))).alias("own")).groupBy(*by).agg(F.min("row").alias("header_row"), F.min_by("own", "row").alias("own"))
        own = first.select(*by, "header_row", F.explode("own").alias("x")).select(*by, "header_row", "x.*")
    else:
        own = own.where(F.col("row") == row).select(*by, F.lit(row).cast("int").alias("header_row"), "col", F.trim(Cell().display()).alias("name"))
    return own.groupBy(*by, "name").agg(F.min("header_row").alias("header_row"), F.min("col").alias("col")).select(*by, "header_row", "col", "name")


def rows_by_headers(cells: DataFrame, headers: DataFrame, schema: StructType, by: list[str], strict: bool = False) -> DataFrame:
    """A row for each sheet row below its range's header row; every range has columns of its own places for the fields.

    headers: by, header_row, col, name. They are few; each range's are gathered and joined to its cells. A range that
    lacks a field raises.
    """
    fields = F.array(*(F.lit(f.name) for f in schema))
    own = headers.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("_names"), F.max("header_row").alias("_header"))
    missing = F.array_except(fields, F.map_values("_names"))
    told = F.raise_error(F.concat(F.lit("no column '"), F.element_at(missing, 1), F.lit("'"))).cast("int")
    own = own.withColumn("_header", F.when(F.size(missing) == 0, F.col("_header")).otherwise(told))
    held = cells.join(own, by).where(F.col("row") > F.col("_header")).withColumn("_field", F.try_element_at("_names", F.col("col")))
    held = held.where(F.col("_field").isin([f.name for f in schema]))
    # values, not cells, are grouped: they are shorter, and are hashed where all fields have a fixed length
    typed = held.select(*by, "row", *(F.when(F.col("_field") == f.name, target(Cell(), f.dataType.simpleString(), strict)).alias(f"__{k}") for k, f in enumerate(schema)))
    picked = typed.groupBy(*by, "row").agg(*(F.max(f"__{k}").alias(f"__{k}") for k in range(len(schema))))
    return picked.select(*by, *(F.col(f"__{k}").alias(f.name) for k, f in enumerate(schema)))


def as_map(cells: DataFrame, columns: dict[str, int], by: list[str], value: Column) -> DataFrame:
    """A map of header to value for each row, without the empty cells."""
    names = F.create_map(*(x for name, col in columns.items() for x in (F.lit(col), F.lit(name))))
    return cells.where(F.col("kind") != "empty").groupBy(*by, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(names[F.col("col")].alias("k"), value.alias("v"))))).alias("values"))


def infer_types(cells: DataFrame) -> dict[int, str]:
    """Column -> type that holds all its kinds; one aggregation over the cells, a row for each column."""
    kinds = cells.where(F.col("kind") != "empty").groupBy("col").agg(F.collect_set("kind").alias("kinds")).collect()

    def one(k: set[str]) -> str:
        if k <= {"int"}:
            return "bigint"
        if k <= {"int", "float"}:
            return "double"
        if k <= {"bool"}:
            return "boolean"
        if k <= {"datetime", "datetime_iso"}:
            return "timestamp_ntz"
        return "string"

    return {r["col"]: one(set(r["kinds"])) for r in kinds}


def select_headers(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by trimmed name, in the given order, the first of equal ones."""
    own: dict[str, str] = {}
    for c in df.columns:
        own.setdefault(c.strip(), c)
    for n in names:
        if n not in own:
            raise HeaderNotFound(f"no column {n!r}")
    return df.select(*(F.col(f"`{own[n]}`").alias(n) for n in names))
