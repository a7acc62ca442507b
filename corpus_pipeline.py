"""From raw documents to packed training sequences, in stages that each reread the last one's rows.

Quality rules reject documents; one document of each group of near duplicates stays; documents that
hold a benchmark item go; secrets are masked in the texts that remain; and these are packed into
sequences. All stages but the last return the columns of documents, extra ones too, whatever their
names; empty tables give empty ones, and very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import decontamination, near_dedup, packing, quality_rules, secrets
from codequarry.llm._common import documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null texts have no words and go; equal rows share a verdict; without labels only the base rules reject."""
    return quality_rules.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id; of rows that tie any one. Null ids come last, a null text is the empty text."""
    return near_dedup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; without items all stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in text and n_chars counted anew. Null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. A null text is the empty text; rows of one id are packed each."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("secret_scan", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes, ProbMinHash and tokenizers have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None
