"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer version, n_tokens). Contents are joined to it by both
digests; only contents without an entry are encoded, each distinct one once, and appended. A run that is
repeated, or a corpus that grows, encodes only what is new.

Defined cases: a null text counts as empty (0 tokens); equal texts, and rows that repeat, share one entry; an
empty table gives no rows; further columns of the input, whatever their names, are not read; very long texts
are counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, shared_path, ship, slices, stored, texts
from .encoding import ByteLevelCounter

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = ByteLevelCounter(path)
        for b in slices(batches, "content"):
            n = [count(x) for x in texts(b, "content")]
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def open_cache(spark, path: str) -> DataFrame:
    """The cache table at a path."""
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, normalise=lambda text: F.coalesce(text, F.lit("")), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row; the cache at ``cache_path`` gets the contents that were new.

    ``normalise`` maps the text column to the content that is counted. Distinct misses are found by a
    grouping with map-side combine, so that a text with very many copies reaches a reducer once per task.
    Counts are joined back by digest, those of frequent contents (fewer than 1024) by broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    fresh = cache_path is None
    cache_path = cache_path or shared_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("content"))
    rows = rows.withColumn("content_digest", F.unhex(F.sha2("content", 256)))
    contents = rows.select("content_digest", "content")
    if not fresh:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)  # so that it exists
        known = open_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
        contents = contents.join(known, "content_digest", "left_anti")
    misses = contents.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    lengths = stored(rows.select("doc_id", "content_digest", F.octet_length("content").cast("long").alias("n_bytes")), "lengths")
    copies = lengths.groupBy("content_digest").agg(F.count("*").alias("copies"))
    counts = open_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(copies.join(counts, "content_digest"), "counts")
    return looked_up(lengths, counts, "content_digest", "copies", lengths.count()).select("doc_id", "n_bytes", "n_tokens")
