"""Ranges: rectangles over the sparse cell relation. Dense forms are made only on demand and under a limit.

Every function takes a cell relation with row and col, and group columns (such as path and sheet) that say
which range a cell belongs to; all ranges are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M

MAX_CELLS = 100_000_000


def _with(cells: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Join to one row for each group, or to the only row where there is no group."""
    return cells.join(few, by) if by else cells.crossJoin(F.broadcast(few))


def used(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("kind") != M.EMPTY)


def bounds(cells: DataFrame, by: list[str]) -> DataFrame:
    """r0, c0, r1, c1 of each range: a partial aggregation, four numbers a group are shuffled."""
    return cells.groupBy(*by).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))


def size(cells: DataFrame, by: list[str]) -> DataFrame:
    """height, width and number of cells of each range."""
    b = bounds(cells, by)
    height, width = (F.col("r1") - F.col("r0") + 1).cast("long"), (F.col("c1") - F.col("c0") + 1).cast("long")
    return b.select(*by, height.alias("height"), width.alias("width"), (height * width).alias("n_cells"))


def last_wins(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """One cell for each position, the last in order; aggregated, so that repeats combine before the shuffle."""
    rest = [c for c in cells.columns if c not in (*by, "row", "col")]
    picked = cells.groupBy(*by, "row", "col").agg(F.max_by(F.struct(*rest), order).alias("v"))
    return picked.select(*by, "row", "col", "v.*")


def grid(rectangles: DataFrame, by: list[str], most: int = MAX_CELLS) -> DataFrame:
    """All positions of rectangles (r0, c0, r1, c1); raises where one has more than ``most``."""
    count = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)
    rows = F.when(count <= most, F.sequence("r0", "r1")).otherwise(F.raise_error(F.lit("cell limit exceeded")).cast("array<int>"))
    return rectangles.select(*by, "c0", "c1", F.explode(rows).alias("row")).select(*by, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def dense(cells: DataFrame, by: list[str], rectangles: DataFrame | None = None, most: int = MAX_CELLS) -> DataFrame:
    """All positions of each range (or of the given rectangles), padded with empty cells."""
    full = grid(bounds(cells, by) if rectangles is None else rectangles, by, most).join(cells, [*by, "row", "col"], "left")
    return full.withColumn("kind", F.coalesce("kind", F.lit(M.EMPTY)))


def between(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The sparse part of a range; a plain filter, which reaches the scan."""
    return cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def relative(cells: DataFrame, by: list[str]) -> DataFrame:
    """Used cells with positions relative to their range's start; the starts are few and joined by key."""
    starts = bounds(cells, by).select(*by, "r0", "c0")
    own = _with(used(cells), starts, by)
    return own.withColumn("row", F.col("row") - F.col("r0")).withColumn("col", F.col("col") - F.col("c0")).drop("r0", "c0")


def rows(cells: DataFrame, by: list[str], value: Column) -> DataFrame:
    """A row for each row of a range, its values as an array by column (missing columns null)."""
    start = bounds(cells, by).select(*by, "c0", "c1")
    own = cells.withColumn("__v", F.struct("col", value.alias("v"))).groupBy(*by, "row").agg(F.map_from_entries(F.collect_list("__v")).alias("m"))
    return _with(own, start, by).select(*by, "row", F.transform(F.sequence("c0", "c1"), lambda c: F.col("m")[c]).alias("values"))


def headers(cells: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Texts of the first row of each range, as wide as the range; what it lacks is an empty text."""
    b = bounds(cells, by).select(*by, F.col("r0").alias("row"), "c0", "c1")
    named = _with(cells, b.select(*by, F.col("row").alias("__r0"), "c0", "c1"), by).where("row = __r0").groupBy(*by, "c0", "c1").agg(F.map_from_entries(F.collect_list(F.struct("col", text.alias("t")))).alias("h"))
    return named.select(*by, F.transform(F.sequence("c0", "c1"), lambda c: F.coalesce(F.col("h")[c], F.lit(""))).alias("headers"))


def header_row(cells: DataFrame, row: int, by: list[str]) -> DataFrame:
    """Cells from a header row on, with an empty cell at that row where it has none, so that the range begins there."""
    kept = cells.where(F.col("row") >= row)
    lacking = kept.groupBy(*by).agg(F.min("row").alias("first"), F.min_by("col", F.struct("row", "col")).alias("col")).where(F.col("first") > row)
    return kept.unionByName(lacking.select(*by, F.lit(row).cast("int").alias("row"), "col", F.lit(M.EMPTY).alias("kind")), allowMissingColumns=True)


def set_values(cells: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """cells with the values of new in place of theirs; the range grows where new lies outside."""
    return last_wins(cells.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)), allowMissingColumns=True), by, "__at").drop("__at")


def in_rectangles(cells: DataFrame, rectangles: DataFrame, by: list[str]) -> DataFrame:
    """Cells joined to the rectangles that contain them.

    A rectangle is expanded to its rows, so that the join has equal keys (group and row) and no pair of a
    cell and a rectangle that lies elsewhere is formed; columns are compared behind it.
    """
    lines = rectangles.withColumn("row", F.explode(F.sequence("r0", "r1")))
    return cells.join(lines, [*by, "row"]).where(F.col("col").between(F.col("c0"), F.col("c1")))


def previous_anchor(cells: DataFrame, by: list[str], order: str, anchor: Column) -> DataFrame:
    """cells with ``anchor``: the latest non-null one up to each cell within its group."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("anchor", F.last(anchor, ignorenulls=True).over(window))
