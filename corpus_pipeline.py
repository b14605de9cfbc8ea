"""The corpus pipeline: stages over ``documents``, each one operator of ``tenun.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenun.llm.decontaminate import contaminated, without_contamination
from tenun.llm.line_chunks import drop_repeated_chunks
from tenun.llm.minhash import keep_one, near_duplicates
from tenun.llm.packing import pack_documents
from tenun.llm.queries import held_out, table, tokenizer_file
from tenun.llm.toxicity import CUT, train_toxicity
from tenun.sources.shared import Workspace

#: Toxicity and near-duplicate classes can't be expressed in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled training documents."""
    model = train_toxicity(table(spark, sf_dir, "documents").where(~held_out()), table(spark, sf_dir, "labels"))
    return docs.where(model.column(F.col("text")) < CUT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks that an earlier document holds are cut out; every document stays.

    ``n_chars``, where there is such a column, is that of the new text.
    """
    cleaned = drop_repeated_chunks(docs)
    if "n_chars" not in docs.columns:
        return cleaned.select(*docs.columns)
    kept = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", kept).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    return keep_one(docs, near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contamination(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again, and goes once the next one is there."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
