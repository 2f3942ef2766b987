"""A corpus pipeline of five stages; each gets the rows that the one before it kept.

Stages decide on rows, not on doc_ids: ids may be null or repeat, rows may repeat, and other columns may have
any names; all but the last stage return the columns that they got. Texts are read whole. Empty tables pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontamination, langid, packing, simhash, toxicity
from gridspark.llm.common import fresh, ship, stored, table

#: Posterior under which a language is not believed.
LEAST_SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a known language; rejected: no letters (so also null and empty texts), or no language that is likely enough.

    Learns from rows whose id has a crc32 that is no multiple of 5; without such rows with a language, all are rejected.
    """
    ship(spark)
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("text", "lang")
    lang, sure = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_sure")
    said = langid.identify(docs, langid.train(learnt), into=(lang, sure))
    return said.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SURE)).drop(lang, sure)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not predicted toxic; without labels of both kinds, all. Null and empty texts are scored like any other."""
    ship(spark)
    learnt = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    net = toxicity.train(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt))
    score = fresh(docs.columns, "toxic_score")
    return toxicity.score_texts(docs, net, into=score).where(F.col(score) < 0.5).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (shingles of five words, similarity 0.8): that of the smallest doc_id.

    Rows without a doc_id come after those with one; of rows that repeat an id, and of repeated rows, one stays.
    Texts without words are a group.
    """
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, of items with an id or without; null and empty texts have none."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, packed into sequences; a null or empty text is one piece with the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("harmless", harmless), ("distinct", distinct), ("uncontaminated", uncontaminated), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, networks and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
