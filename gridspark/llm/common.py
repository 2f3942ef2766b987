"""Helpers that the corpus operators share: the shared folder, shipping of the package, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a new folder of this machine serves a local session; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts lineage: a lost executor costs no recomputation of what is stored.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def looked_up(rows: DataFrame, values: DataFrame, key: str, copies: str, total: int, share: int = 1024) -> DataFrame:
    """Rows (stored) joined with the value of their key, of which each row has one.

    Keys of more than one row in ``share``, of which there are fewer than ``share``, are broadcast; so no task
    gets all rows of a frequent key. The others are joined by sorting.
    """
    many = F.col(copies) * share > total
    flag = fresh([*rows.columns, *values.columns], "frequent")
    met = rows.join(F.broadcast(values.where(many).drop(copies).withColumn(flag, F.lit(True))), key, "left")
    rest = met.where(F.col(flag).isNull()).select(*rows.columns).join(values.where(~many).drop(copies).hint("merge"), key)
    return met.where(flag).drop(flag).unionByName(rest)


def widened(docs: DataFrame, run: Callable, *added: StructField) -> DataFrame:
    """``docs.mapInArrow(run)`` for a ``run`` that returns all columns and the added ones; any column names will do."""
    names = docs.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, StructType([*docs.schema.fields, *added]))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the ``text`` column of each holds about ``most`` bytes (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a small table; raises where it has more than ``most``, before they reach the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
