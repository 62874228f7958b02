"""The training-data pipeline: five stages over documents, each calling one operator.

1. language ID: documents without a recognizable language go;
2. SimHash near-dedup: one document of each group of near copies stays;
3. PII: personal data gets surrogates;
4. mixing: every document as often as the curriculum takes it, in training order;
5. packing: what is left becomes token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, language, mixing, packing, pii, simhash


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.stage(spark, docs, sf_dir)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.stage(spark, docs, sf_dir)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.stage(spark, docs, sf_dir)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(spark, docs, sf_dir)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("language_id", _language),
    ("simhash_near_dedup", _near_dedup),
    ("pii_surrogates", _pii),
    ("curriculum_mixing", _mixing),
    ("sequence_packing", _packing),
]

#: Language models, fingerprints and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
