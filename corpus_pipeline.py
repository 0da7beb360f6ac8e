"""The corpus pipeline: stages that each take and return documents, written and read again between.

Toxic documents go, then exact copies, near copies (five-word shingles, similarity 0.8) and documents
that hold a benchmark item; the rest is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.bpe import bpe_digest
from skylattice.llm.common import written
from skylattice.llm.decontaminate import drop_contaminated
from skylattice.llm.exact_dedup import drop_exact_copies
from skylattice.llm.near_dedup import drop_near_copies
from skylattice.llm.queries import TOKENIZERS, table
from skylattice.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digest(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("benchmark", benchmark), ("encode", encode)]
#: The toxicity and BPE stages have no SQL form; a test compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
