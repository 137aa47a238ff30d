"""Corpus pipeline: documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8).
3. decontamination: benchmark passages are cut out; a document that is mostly benchmark text goes.
4. pii: personal data get surrogates.
5. packing: token pieces of at most 4096 tokens in as few sequences as the packing finds.

Null texts pass as empty ones (and are near-duplicates of nothing); an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bin_packing, decontamination, near_duplicates, pii_surrogates, queries, toxicity
from cohortlens.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(docs, queries.PII_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(docs, queries.WORD_BPE, end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # no stage can be written in SQL: classifiers, signatures and tokenizers


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
