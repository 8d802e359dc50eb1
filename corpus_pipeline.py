"""From raw documents to token files: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the
shared folder and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.queries import token_digest
from tidemark.llm.scratch import Scratch
from tidemark.llm.toxicity import drop_toxic

NAME = "documents"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects."""
    return drop_toxic(docs, _read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least doc_id.

    Rows that share a doc_id with different texts are different documents; of rows
    alike in doc_id and text one stays.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the source weights ask."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns their digest: (doc_id, start, n_tokens, ids_crc32)."""
    return token_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Trained scores and signatures are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = _read(spark, sf_dir, NAME)
    for i, (name, stage) in enumerate(STAGES):
        done = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
        docs = done
    return docs
