"""Corpus pipeline: documents through five corpus operators, stage by stage.

Toxic documents go, one of each class of near-duplicates stays, personal data is replaced, sources
are read to their target weights, and what remains is tokenised and packed. Each stage is written
as Parquet in the shared folder and read again as the next one's documents; all but the last return
the columns of the documents table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm import mixing, near_dedup, packing, pii, toxicity
from ticketlake.llm.common import read_table, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("personal_data", _personal_data),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: Learned scores and byte-pair tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
