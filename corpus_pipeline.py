"""A training-data pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Each stage takes what the one before kept, written as Parquet to the shared folder and read again,
so a lost executor costs no more than the stage that runs. Stages judge their own input.

Defined cases: rows with a null or empty text fail the quality rules; rows with a null doc_id pass
the stages that compare documents and are judged by the others; an empty table passes as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, line_dedup, ngram_join, quality_rules, queries, sentencepiece_codec
from turnloom.llm.common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the list learned from the labels reject."""
    rules = quality_rules.learn_from(docs, queries.table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those of which nothing is left go."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five words, similarity 0.75 or more."""
    return ngram_join.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with its parity and round trip."""
    return sentencepiece_codec.encoded(docs, queries.model_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Learned rules and encoding are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns what the last one makes."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
