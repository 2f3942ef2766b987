"""Token ids in Simple-8b files: word-aligned coding with per-block offsets.

A 64-bit word has a 4-bit selector on top and 60 bits of ids below, the first id lowest. A selector says
how many ids of which width the word holds; selector 0 is the escape: the next word holds one id of up to
64 bits as it is. A stream is cut into blocks of a fixed number of ids, each beginning on a word of its
own; the table of block offsets lets any block be decoded alone and all of them at once, vectorised.

One file image is::

    b"S8BF", u32 version, u64 n_docs, u64 n_ids, u64 n_words, u64 n_blocks,
    i64 doc_id[n_docs], u64 n_tokens[n_docs], u64 block_offset[n_blocks + 1], u64 word[n_words]

Images are rows of a Parquet table in the shared folder, so that any file system that Spark writes to will
do. They hold ascending doc_ids; a range partitioning by doc_id makes partitions ascend too. Where a
document begins in the whole corpus is its partition's base (a running sum over partitions, one row each)
plus the ids before it in its partition, which the images carry.

Defined cases: a null text is empty and has only the end id; rows without a doc_id come first; rows that repeat a doc_id stay in the same
partition, in the order of their texts; an empty table gives no rows; columns beside doc_id and text are
not read. A file holds whole documents, so a document's ids must fit into a worker's memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored, texts
from .encoding import WordIds

MAGIC = b"S8BF"
#: ids a word holds and their width, by selector from 1; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
SELECTORS = range(1, 15)
BLOCK = 8192
FILE_IDS = 2_000_000
#: Written for a missing doc_id, which sorts first.
NO_ID = -(1 << 63)


_PAD = 60  # places behind a block that count as zeros
_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bit_widths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < len(_BITS):
        return _BITS[ids.astype(np.intp)]
    return sum((ids >= np.uint64(1 << b)).astype(np.uint8) for b in range(64))


def _selectors(widths: np.ndarray) -> np.ndarray:
    """For each place of each block (a row) the selector that packs the most ids from there on; 0: none fits.

    The largest width among the next n places is made from that among fewer, by one maximum for each n.
    """
    size = widths.shape[1] - _PAD
    largest = {1: widths}
    best = np.zeros((len(widths), size), np.uint8)
    best[widths[:, :size] <= WIDTHS[14]] = 14
    for n, parts in ((2, (1, 1)), (3, (2, 1)), (4, (2, 2)), (5, (4, 1)), (6, (3, 3)), (7, (4, 3)), (8, (4, 4)), (10, (5, 5)), (12, (6, 6)), (15, (8, 7)), (20, (10, 10)), (30, (15, 15)), (60, (30, 30))):
        first, second = largest[parts[0]], largest[parts[1]][:, parts[0] :]
        w = min(first.shape[1], second.shape[1])
        largest[n] = np.maximum(first[:, :w], second[:, :w])
        s = int(np.flatnonzero(COUNTS[1:15] == n)[0]) + 1
        best[largest[n][:, :size] <= WIDTHS[s]] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a stream of ids, and where each block's words begin (and the last one's end)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    rows = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    rows[:, :BLOCK] = full.reshape(blocks, BLOCK)
    best = _selectors(_bit_widths(rows.reshape(-1)).reshape(rows.shape))
    steps, head = COUNTS[best], np.zeros((blocks, BLOCK), bool)
    ends = np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(live):  # from word to word, in all blocks at once
        head[live, at] = True
        at = at + steps[live, at]
        more = at < ends[live]
        at, live = at[more], live[more]
    block, place = np.nonzero(head)
    chosen = best[block, place]
    taken = np.where(chosen == 0, 2, 1)
    before = np.concatenate([[0], np.cumsum(taken)])
    words = np.zeros(int(before[-1]), np.uint64)
    flat, source = rows.reshape(-1), block * (BLOCK + _PAD) + place
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        if s == 0:
            words[before[own] + 1] = flat[source[own]]
            continue
        word = np.full(len(own), s << 60, np.uint64)
        for k in range(COUNTS[s]):
            word |= flat[source[own] + k] << np.uint64(k * WIDTHS[s])
        words[before[own]] = word
    offsets = before[np.concatenate([np.searchsorted(block, np.arange(blocks)), [len(block)]])]
    return words, offsets.astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of a stream. Whole blocks only need their own slice of words and two offsets."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:  # a word behind an escape is an id, whatever its top bits look like
            raw[i + 1] = True
    held = np.where(raw, 1, np.where(selector == 0, 0, COUNTS[selector]))
    before = np.concatenate([[0], np.cumsum(held)])
    starts = offsets.astype(np.int64)
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    within = before[:-1] - before[starts[:-1]][block]
    end = np.minimum(n_ids - block * BLOCK, BLOCK)
    out = np.zeros(n_ids, np.uint64)
    if raw.any():
        out[(block * BLOCK + within)[raw]] = words[raw]
    for s in SELECTORS:
        rows = np.flatnonzero((selector == s) & ~raw)
        if not len(rows):
            continue
        lanes = (words[rows][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
        place = within[rows][:, None] + np.arange(COUNTS[s])
        fits = place < end[rows][:, None]
        out[((block[rows] * BLOCK)[:, None] + place)[fits]] = lanes[fits]
    return out


def file_image(doc_ids: list[int], parts: list[bytes]) -> bytes:
    """File of some documents' ids, each given as little-endian unsigned 32-bit bytes."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    words, offsets = encode(ids)
    head = struct.pack("<4sIQQQQ", MAGIC, 1, len(doc_ids), len(ids), len(words), len(offsets) - 1)
    counts = np.array([len(p) // 4 for p in parts], "<u8")
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), counts.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids."""
    magic, version, n_docs, n_ids, n_words, n_blocks = struct.unpack_from("<4sIQQQQ", image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a Simple-8b file of version 1")
    at = struct.calcsize("<4sIQQQQ")
    parts = []
    for kind, n in (("<i8", n_docs), ("<u8", n_docs), ("<u8", n_blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(image, kind, n, at))
        at += 8 * n
    return parts[0], parts[1].astype(np.int64), decode(parts[3], parts[2], n_ids)


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """The stored file images: part, part_start (ids of the partition before the file), n_ids, image."""
    ship(docs.sparkSession)
    partitions = partitions or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["part", "part_start", "n_ids", "image"]
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, doc_ids, parts = TaskContext.get().partitionId(), 0, 0, [], []
        ids_of = WordIds(tokenizer_path)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done]), pa.array([held]), pa.array([file_image(doc_ids, parts)], pa.binary())], names=names)

        for b in slices(batches, "text"):
            for doc_id, x in zip(b.column("doc_id").to_pylist(), texts(b)):
                doc_ids.append(doc_id)
                parts.append(ids_of(x) + end)
                held += len(parts[-1]) // 4
                if held >= file_ids:
                    yield flush()
                    done, held, doc_ids, parts = done + held, 0, [], []
        if doc_ids:
            yield flush()

    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part int, part_start long, n_ids long, image binary"), "simple8b")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored images."""
    spark = files.sparkSession
    base, sums = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):  # one row for each partition
        sums.append((part, base))
        base += n
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, image in zip(b.column("start").to_pylist(), b.column("image")):
                doc_ids, counts, ids = read_image(image.as_buffer())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=names)

    bases = spark.createDataFrame(sums, "part int, base long") if sums else spark.createDataFrame([], "part int, base long")
    located = files.join(bases, "part").select((F.col("base") + F.col("part_start")).alias("start"), "image")
    return located.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
