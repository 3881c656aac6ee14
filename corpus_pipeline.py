"""A corpus pipeline: five corpus operators, each over all that its predecessor kept.

Language ID drops documents in no known language; near-dedup keeps the least id of each class; decontamination drops
documents that hold a benchmark window; the secret scan redacts live secrets and keeps every document; the last stage
encodes what is left, each document in two sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, dedup, language, pieces, secrets
from tessera.llm.common import read, settle
from tessera.llm.queries import held_out, model_bytes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language. Null texts and texts without a letter go; null languages and ids teach
    nothing; repeated rows fare alike; without rows to learn from there are none to keep."""
    machines = language.fit(docs, F.col("text"), F.col("lang"), ~held_out(), F.col("doc_id"))
    return language.keep_known(docs, F.col("text"), machines)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each class. Null texts and ids stand as ``dedup.keep_one`` tells; columns of any name stay."""
    return dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Null and empty texts hold none and stay; repeated rows fare alike."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), F.col("text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts live secrets and mends ``n_chars``; every row stays, null texts and ids and repeated rows too."""
    return secrets.redact_secrets(docs, "doc_id", "text", "source", "source", "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as ``pieces.sample_pieces`` tells; no rows give none."""
    found = pieces.sample_pieces(docs, F.col("doc_id"), F.col("text"), model_bytes())
    return found.withColumnRenamed("row_id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", secret_scan),
    ("SentencePiece encoding", encode),
]
#: Fitted models, alignments and sampling can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
