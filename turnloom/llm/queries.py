"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import (
    chat_format, decontaminate, html_extract, license_scan, line_dedup, merkle_manifest, ngram_join, quality_classifier,
    quality_rules, sentencepiece_codec, substring_dedup, toxicity, whitening)
from turnloom.llm.sql import CHAT_SQL, JACCARD_SQL, LINE_SQL, MERKLE_SQL, SUBSTRING_SQL

#: Places of the tokenizer model; the first one that is set or installed is taken.
MODEL_SETTING = "TURNLOOM_PIECE_MODEL"
MODEL_FILE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    """The model file named in the environment, else the one of the installed vocabularies."""
    if named := os.environ.get(MODEL_SETTING):
        return named
    installed = importlib.util.find_spec("public_tokenizers")
    if installed is None:
        return f"/opt/tokenizers/{MODEL_FILE}"
    return os.path.join(os.path.dirname(installed.origin), MODEL_FILE)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judged(documents, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"), model_path(), with_ids=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = quality_classifier.train_from(documents, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(documents, machine)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.train_from(pages))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_chats(turns.unionByName(extra)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.train_from(documents, table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extract": op6_html_extract,
    "op7_ngram_join": op7_ngram_join,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_merkle_manifest": op13_merkle_manifest,
}

CHECKS: dict[str, str] = {
    "op3_substring_dedup": SUBSTRING_SQL, "op7_ngram_join": JACCARD_SQL, "op9_chat_format": CHAT_SQL, "op10_line_dedup": LINE_SQL,
    "op13_merkle_manifest": MERKLE_SQL}
