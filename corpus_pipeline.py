"""Corpus pipeline over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  A stage's result is
written as Parquet and read again as the next stage's ``docs``; all but the last
return the columns of ``documents``.

1. quality: documents that importance resampling does not draw go.
2. near duplicates: of documents linked by five-word n-gram sets with a Jaccard
   similarity of 0.8 or more, the one with the smallest doc_id stays.
3. repeated passages: bytes covered by a 100-byte window that also starts earlier
   go; a cut inside a character drops that character's other bytes too.  Documents
   of which nothing stays go.
4. packing into sequences of 4,096 tokens.

Stages 1 and 2 decide on rows, not ids: rows that share a doc_id are judged by
their own texts, and rows with a null doc_id like others; in stage 2 a null
doc_id comes last, and of rows equal in doc_id and text one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import ngram_join, packing, quality, suffix_dedup
from vigil.llm.common import importable, read, shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return ngram_join.one_of_each(docs, 5, 80, 100)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return suffix_dedup.cleaned(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.packed_documents(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; between stages the documents are
    written to the folder that driver and executors share."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_folder(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
