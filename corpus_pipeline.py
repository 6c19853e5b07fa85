"""The corpus pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkling.llm.common import materialize, table
from inkling.llm.decontamination import without_leaks
from inkling.llm.language_id import accepted
from inkling.llm.line_dedup import drop_repeated_lines
from inkling.llm.packing import pack
from inkling.llm.simhash import one_of_each


def _bounded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Short Arrow batches, as documents may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a score of 0.3 or more."""
    return accepted(_bounded(spark, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 or more characters stay in the smallest doc_id that holds them; n_chars follows the text."""
    return drop_repeated_lines(_bounded(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints within three bits."""
    return one_of_each(_bounded(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(_bounded(spark, docs), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 2,048 tokens."""
    return pack(_bounded(spark, docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, tokens and trained models are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
