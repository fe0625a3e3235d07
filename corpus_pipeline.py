"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, then byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last keep the columns of their docs, whatever their names. Every stage takes an empty table, nulls in any
column, empty and very long texts, and ids and rows that repeat; what becomes of them stands with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, decontam, near_dup, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose chance of label 1 is under one half; the labels teach as in the operator's own query.

    A null text is judged as an empty one. Rows with the same text stay or go together. Rows without an id teach nothing. Texts
    are judged whole.
    """
    common.ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), common.fold(F.col("doc_id"), 3) != 1)
    return quality.kept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: of the smallest doc_id (no id comes last), then of the smallest key of id and text.

    Rows with that document's id and text stay once, whichever of them. Null texts and texts without words resemble none, so
    they stay; those with the same id and text stay once. All shingles of long texts count.
    """
    common.ship(spark)
    return near_dup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts have none. Rows with the same id and text go together. Long texts are searched whole.
    """
    common.ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    A null text is an empty one, with no tokens. Every row gives one row, also if it repeats or has no id. Other columns go.
    """
    common.ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can express neither trained dictionaries nor merges; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
