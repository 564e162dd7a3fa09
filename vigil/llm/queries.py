"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from vigil.llm import (bpe, fingerprints, language_id, ngram_join, packing, quality, ranked_search, sharding, suffix_dedup, url_filter, vptree, warc,
                       whitening)
from vigil.llm.common import read, shared_folder

N_SHARDS = 40
SAMPLE_SHARE = 0.5
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprints(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
                       fingerprints.distinct_shingles(F.col("sketch")).alias("n_shingles"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(base, base.where(F.col("vec_id") % 20 == 0), 20)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), 3, 90, 100)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    return url_filter.judge(pages, url_filter.fit(pages, labels), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws as clean, with weight and key;
    ``sampled``: whether a draw of ``SAMPLE_SHARE`` of them takes this one."""
    rows = quality.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality.drawn(rows, SAMPLE_SHARE, "sampled").where("kept").select("doc_id", "log_weight", "n_grams", "gumbel_key", "sampled")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived_captures(spark, read(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), N_SHARDS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed_documents(read(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "cost")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


RANKED_SQL = r"""
WITH matched AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM matched GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM matched GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_vptree, op4_ngram_join, op5_url_filter, op6_quality, op7_warc, op8_sharding, op9_suffix_dedup, op10_packing,
                                   op11_whitening, op12_language_id, op13_ranked_search)}
ORACLE: dict[str, str] = {"op13_ranked_search": RANKED_SQL}
