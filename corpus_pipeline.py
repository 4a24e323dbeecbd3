"""Corpus pipeline: toxicity, exact duplicates, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and read
again for the next one. The duplicate stages decide on rows: ids may repeat or be null. The stages before packing keep
the columns of ``documents``, other columns too, whatever their names.

Defined cases, for each stage: an empty table gives an empty result; null and empty texts are kept by toxicity (unless
the intercept alone rejects) and by near_dedup, are one group in exact_dedup, hold no secrets, and are packed as the end
token; texts of any length are whole; wholly equal rows are two rows everywhere but in exact_dedup, which keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, table, with_row_ids, without
from axonflow.llm.exact_dedup import exact_dedup
from axonflow.llm.minhash import near_duplicates
from axonflow.llm.packing import pack
from axonflow.llm.secrets import redact
from axonflow.llm.toxicity import fit, reject_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier rejects (operator 9)."""
    return reject_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Rows that ``decide`` (doc_id, kept from doc_id, text) keeps; it is given row numbers as ids."""
    rows = with_row_ids(docs, "row_id", f"{name}-rows")
    found = decide(rows.select(F.col("row_id").alias("doc_id"), "text"))
    return without(rows, found.where("NOT kept").select(F.col("doc_id").alias("row_id")), f"{name}-dropped", "row_id").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, with the smallest id, of each group of equal texts (operator 10)."""
    return _kept(docs, exact_dedup, "exact")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, with the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8 (operator 7)."""
    return _kept(docs, lambda rows: near_duplicates(rows, words=5, percent=80), "near")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kind in brackets; keeps every document (operator 4)."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096 ids, one row a piece (operator 6); workers that ran all other stages remember fewer words."""
    return pack(docs, remembered=50_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
