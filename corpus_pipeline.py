"""From raw documents to packed sequences: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents. Null, empty and very long texts: empty ones fail
the limits of the first stage, long ones are read whole by each. Rows without a doc_id stay in near_dedup, as they
link with nothing; of equal rows one stays. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import table, written
from kindred.llm.near_dedup import NearDedup
from kindred.llm.packing import Packer
from kindred.llm.pii import PersonalData
from kindred.llm.quality_rules import QualityRules
from kindred.llm.queries import tokenizer_path
from kindred.llm.toxicity import Toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or that the trees reject go."""
    return QualityRules().fit(docs, table(spark, sf_dir, "labels")).filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return Toxicity().fit(docs, table(spark, sf_dir, "labels")).filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document of the smallest doc_id stays."""
    return NearDedup(percent=80, bands=12).kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return PersonalData().redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    return Packer(tokenizer_path("word_bpe_49k.json")).packed(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: SQL can express neither the fitted models nor the packing; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
