"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled training text, hashed into a fixed number of buckets, per
language. Each task adds its batches up in one (language x bucket) table and emits that, so that one row
per task, language and non-empty bucket is shuffled. The matrix of log-probabilities is cut into blocks of
``BLOCK`` languages, each of a proven size (languages x buckets x 8 bytes) and broadcast; batches of texts are
scored in numpy by gathers from the matrix and sums over each text's n-grams. Where labels name more languages
than one block holds, each block scores all texts in a pass of its own and the passes are put together by row.
Priors are the shares of the training texts, one text added to each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that
sorts first; equal texts, and rows that repeat, get equal results; without any training row every text is
``und``; labels that are null teach nothing; rows without a doc_id are not held out; an empty table gives no
rows; other columns, whatever their names, are passed on as they are; very long texts are read whole. lang,
source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import fresh, ship, slices, stored, texts, widened

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of one matrix.
BLOCK = 256
#: n-grams after which the posterior grows no surer.
CONFIDENT = 40
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _points(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each led and ended by a space; and where each text begins.

    Runs of what is no letter become one space: digits, marks and blanks tell no language.
    """
    joined = [f" {x.lower()} " for x in batch_texts]
    starts = np.zeros(len(joined) + 1, np.int64)
    np.cumsum([len(x) for x in joined], out=starts[1:])
    cp = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((cp >= 97) & (cp <= 122)) | ((cp >= 0xC0) & (cp != 0xD7) & (cp != 0xF7)) | (cp == 0xAA) | (cp == 0xB5) | (cp == 0xBA)
    if (high := cp >= 0x250).any():  # beyond Latin, by Unicode's own classes
        for c in np.unique(cp[high]):
            if not chr(c).isalpha():
                letter[cp == c] = False
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[starts[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, cp, np.uint32(32))[keep], before[starts]


def _grams(cp: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams, and where each text's n-grams begin."""
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(cp) < n:
                continue
            h = np.full(len(cp) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ cp[i : len(cp) - n + 1 + i]) * _ODD[i]
                h ^= h >> np.uint32(15)
            inside = np.ones(len(h), bool)  # no n-gram spans two texts
            for i in range(1, n):
                cut = starts[1:-1] - i
                inside[cut[(cut >= 0) & (cut < len(h))]] = False
            lengths = np.maximum(np.diff(starts) - n + 1, 0)
            yield (h % np.uint32(BUCKETS))[inside], np.concatenate([[0], np.cumsum(lengths)])


class Block(NamedTuple):
    """Some languages, in order, with their log-probabilities [language, bucket] and log priors."""

    languages: list[str]
    matrix: np.ndarray
    priors: np.ndarray


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> Iterator[Block]:
    """Blocks of languages, in order, from all rows with a language; the driver holds one block at a time."""
    spark = rows.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in total.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(held[at], docs[lang]))], names=["lang", "bucket", "n"])
            total.clear()
            docs.clear()

        for b in slices(batches, "text"):
            by: dict[str, list[str]] = {}
            for x, lang in zip(texts(b), b.column("lang").to_pylist()):
                by.setdefault(lang, []).append(x)
            for lang, own in by.items():
                if len(total) >= BLOCK and lang not in total:
                    yield from flush()
                docs[lang] = docs.get(lang, 0) + len(own)
                held = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for buckets, _ in _grams(*_points(own)):
                    held += np.bincount(buckets, minlength=BUCKETS)
        yield from flush()

    counted = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null").mapInArrow(count, "lang string, bucket long, n long")
    counted = stored(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"), F.max(F.when(F.col("bucket") == -1, F.col("n"))).alias("docs")), "languages")
    languages, total = counted.agg(F.count("*"), F.sum("docs")).first()

    def made(found: list) -> Block:
        matrix = np.full((len(found), BUCKETS), 0.5)
        for k, r in enumerate(found):
            for bucket, n in r["c"]:
                if bucket >= 0:
                    matrix[k, bucket] += n
        priors = np.log(np.array([r["docs"] + 1.0 for r in found]) / (total + languages))
        return Block([r["lang"] for r in found], np.log(matrix / matrix.sum(1, keepdims=True)), priors)

    if languages <= block:
        if languages:
            yield made(sorted(counted.collect(), key=lambda r: r["lang"]))
        return
    held = []
    for r in counted.orderBy("lang").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield made(held)
            held = []
    if held:
        yield made(held)


def score(batch_texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the block's best language, its log-probability, the block's mass over it, and whether it has a letter."""
    cp, starts = _points(batch_texts)
    total = np.zeros((len(batch_texts), len(block.languages)))
    grams = np.zeros(len(batch_texts))
    for buckets, begin in _grams(cp, starts):
        grams += np.diff(begin)
        for k, row in enumerate(block.matrix):
            total[:, k] += np.diff(np.concatenate([[0.0], np.cumsum(row[buckets])])[begin])
    tempered = total * (np.minimum(grams, CONFIDENT) / np.maximum(grams, 1))[:, None] + block.priors
    most = tempered.max(1)
    letters = np.diff(np.concatenate([[0], np.cumsum(cp != 32)])[starts]) > 0
    return tempered.argmax(1), most, np.exp(tempered - most[:, None]).sum(1), letters


def identify(docs: DataFrame, model: Iterator[Block], text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of every row, with the language and its posterior (in columns named ``into``)."""
    spark = docs.sparkSession
    ship(spark)
    model = iter(model)
    block, second = next(model, None), next(model, None)
    if second is not None:
        return _identify_by_blocks(docs, [block, second], model, text_col, into)
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches, text_col, 2_000_000):
            if own:
                best, _, mass, letters = score(texts(b, text_col), own)
                said = [own.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                sure = np.where(letters, 1 / mass, 0.0)
            else:
                said, sure = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names, *into])

    return widened(docs, run, StructField(into[0], StringType()), StructField(into[1], DoubleType()))


def _identify_by_blocks(docs: DataFrame, first: list[Block], others: Iterator[Block], text_col: str, into: tuple[str, str]) -> DataFrame:
    """``identify`` by a pass over all texts for each block of languages."""
    spark = docs.sparkSession
    key = fresh([*docs.columns, *into], "row")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    asked = rows.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text"))
    passes = []
    for block in chain(first, others):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in slices(batches, "text", 2_000_000):
                best, most, mass, letters = score(texts(b), own)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([own.languages[k] for k in best.tolist()]), pa.array(most), pa.array(mass), pa.array(letters)], names=["row", "lang", "most", "mass", "letters"])

        passes.append(stored(asked.mapInArrow(run, "row long, lang string, most double, mass double, letters boolean"), "languages-of-block"))
        sent.unpersist()
    together = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("most")).alias("least"), "lang", "mass"))).alias("c"), F.max("letters").alias("letters"))
    mass = F.aggregate("c", F.lit(0.0), lambda sum_, x: sum_ + x["mass"] * F.exp(F.col("c")[0]["least"] - x["least"]))
    found = together.select(F.col("row").alias(key), F.when(F.col("letters"), F.col("c")[0]["lang"]).otherwise("und").alias(into[0]), F.when(F.col("letters"), 1 / mass).otherwise(0.0).alias(into[1]))
    return rows.join(found, key).drop(key)


def predict_languages(docs: DataFrame, parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held_out, F.lit(False)).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
