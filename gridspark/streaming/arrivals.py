"""Workbooks as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import auto

_FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.{xlsx,xlsm,xlam,xlsb,ods,xls,xla}", **trigger) -> StreamingQuery:
    """Append the cells of new workbooks under ``out``, each batch in a folder of its own.

    A batch is a relation of paths and contents, as the sources take it: nothing of it is collected. One that is run again
    after a failure overwrites its own folder.
    """
    arrived = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def each(batch: DataFrame, number: int) -> None:
        auto.cells(batch.sparkSession, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
