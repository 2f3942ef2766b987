"""All queries over the driver's tables, with their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import algebra, formulas, members, workbooks

QUERIES: dict = {**algebra.QUERIES, **workbooks.QUERIES, **formulas.QUERIES, **members.QUERIES}
ORACLE_SQL: dict[str, str] = {**algebra.ORACLE_SQL, **workbooks.ORACLE_SQL, **formulas.ORACLE_SQL, **members.ORACLE_SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbooks.nations_by_region_from_workbook(spark, sf_dir)
