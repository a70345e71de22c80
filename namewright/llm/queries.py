"""Registered queries of this subpackage: op1 to op10 and the pipeline, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from namewright.llm import hidden_markov, media, near_dedup, packing, piece_dropout, quality_classifier, quality_rules, suffix_dedup, toxicity, warc
from namewright.llm.common import new_path, table
from namewright.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    out = warc.read_archive(spark, path)
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return hidden_markov.score(table(spark, sf_dir, "documents"), held)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents")).drop("text_hash", "char_js", "word_js")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.analyse(media.encode(table(spark, sf_dir, "documents"))).drop("fingerprint")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    out = piece_dropout.decode(piece_dropout.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", "n_pieces", "n_skipped", F.crc32("ids").alias("ids_crc32"), "text_sha256", (F.sha2("text", 256) == F.col("text_sha256")).alias("lossless"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_classifier.score(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "p_document", "host_posterior", "path_posterior", "p_quality", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_piece_dropout": op8_piece_dropout,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": pipeline,
}
