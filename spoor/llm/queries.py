"""The operators of this subpackage as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spoor.llm import (ann, bpe, decontam, extract, langid, merkle, oracles, packing, quality, repair, secrets, shard, simhash,
                       warc)
from spoor.llm.common import remainder, run_path, small_batches, table
from spoor.session import configure

RANKS = "byte_bpe_multi_50k.tiktoken"
EOS = 50256                # free in that file
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_conversation_repair": oracles.OP11, "op12_owned_secrets": oracles.OP12,
                           "op13_bitmap_manifest": oracles.OP13}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        small_batches(spark)
        return build(spark, sf_dir)
    QUERIES[build.__name__] = run
    return build


@query
def op1_label_shards(spark, sf_dir):
    return shard.shard_documents(table(spark, sf_dir, "documents"), 8)


@query
def op2_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_multiprobe_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return ann.nearest(rows, asked, 5)


@query
def op4_quality_machine(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(remainder("doc_id", 4) != 2))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= quality.PREDICT_AT).cast("int").alias("predicted"))


@query
def op5_warc_dictionary(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_bpe_digests(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op7_template_leaks(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_packed_ids(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), run_path(spark, "packed-ids"),
                                  public_tokenizers.path(RANKS), public_tokenizers.PATTERN, EOS)


@query
def op9_consensus_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract_text(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                              F.length("main_text").cast("long").alias("n_chars"))


@query
def op10_centroid_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "prediction.lang_pred",
                        "prediction.score", "prediction.rejected")


@query
def op11_conversation_repair(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return repair.repair_conversations(repair.damaged(talks), talks)


@query
def op12_owned_secrets(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op13_bitmap_manifest(spark, sf_dir):
    return merkle.audit_documents(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
