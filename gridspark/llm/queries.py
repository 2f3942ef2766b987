"""Queries over the corpus tables, one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, centroids, decontamination, gif_media, langid, merkle, minhash, oracles, packing, simhash, simple8b, token_counts, toxicity, url_rules
from .common import stored, table

#: host and path of a rule in one string, and what it does
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 512 AS over_limit")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.gif_features(stored(gif_media.encode_gifs(table(spark, sf_dir, "documents")), "gif-media"))


def op5_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.language_model(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return simple8b.read_files(files)


def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_url_rules": op3_url_rules,
    "op4_gif_media": op4_gif_media,
    "op5_linear_grouping_packing": op5_linear_grouping_packing,
    "op6_cgk_decontamination": op6_cgk_decontamination,
    "op7_language_id": op7_language_id,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_toxicity": op9_toxicity,
    "op10_simple8b_files": op10_simple8b_files,
    "op11_tensored_minhash": op11_tensored_minhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL = {
    "op3_url_rules": r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, rule, verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT parts.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)""",
    "op11_tensored_minhash": oracles.TENSORED_MINHASH,
    "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
    "op13_centroid_clustering": oracles.CENTROID_CLUSTERING,
}
