"""Corpus pipeline: the training-data operators as stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
stage works on all that the stage before it kept, and run() writes each stage's result before the next one reads it.

Defined results of all stages: a null text counts as empty and stays null; rows that repeat a doc_id, and rows without one, are
kept as they are unless their own text is toxic or a near copy (a row without doc_id is a copy of none); extra columns of any
name pass through all but the last stage; texts of any length are taken whole; ties are those of the operators; empty
documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ladderflow.llm import jaccard_join, line_dedup, packing, pii, queries, toxicity
from ladderflow.llm.common import materialize, prepare, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine rejects."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned common blocks from later documents; documents of which nothing is left go."""
    prepare(spark)
    return line_dedup.left_over(line_dedup.dedup(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    prepare(spark)
    return jaccard_join.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    prepare(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences."""
    prepare(spark)
    return packing.pack(docs, queries.byte_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**queries.QUERIES, "pipeline": run}
ORACLE = dict(queries.ORACLE)
