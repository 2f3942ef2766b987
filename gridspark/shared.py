"""The folder that driver and executors share, and relations that are stored there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); any file system that Spark reaches."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(path or tempfile.mkdtemp(prefix='gridspark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, and read again: what follows branches off without doing it anew.

    group: rows of a row group at most, for long rows. A reader decodes a row group at once, and Parquet bounds its bytes only as
    they are compressed.
    """
    spark = df.sparkSession
    at = shared_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer if group is None else writer.option("parquet.block.row.count.limit", group)).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
