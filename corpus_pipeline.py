"""From raw documents to token ids: language, quality, near duplicates, benchmark leaks, encoding.

Null and empty texts have no language and go in the first stage; rows that repeat a doc_id go through as they are until
near duplicates, where one row of a group stays; rows without a doc_id cannot be leaks and stay. Columns beyond those
of documents are kept but for the last stage, and may have any name. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import bpe, decontam, langid, quality, simhash
from spoor.llm.common import remainder, small_batches, stage, table

ORACLE_SQL = None    # the stages are learnt models, a graph and a tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts too far from every language."""
    small_batches(spark)
    model = langid.fit_languages(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.predict_languages(docs, model, "_language_found")
    return found.filter(~F.col("_language_found.rejected")).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores at least ``quality.PREDICT_AT``."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels), "_quality_found")
    return scored.filter(F.col("_quality_found") >= quality.PREDICT_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and proof that they decode to it."""
    small_batches(spark)
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", identify_language), ("quality classifier", classify_quality),
          ("SimHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_leaks),
          ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
