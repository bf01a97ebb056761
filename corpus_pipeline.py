"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and its result is written as Parquet into the shared folder and read again as
the next stage's documents; tables that a stage wrote for itself are deleted. All stages but the last return the columns
of the documents, whatever these are called; only ``doc_id`` and ``text`` are read. An empty table gives an empty one. A
text of any length is read whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from veridex.llm._common import alone, table
from veridex.llm.decontamination import keep_uncontaminated
from veridex.llm.near_duplicates import keep_one_of_each
from veridex.llm.packing import packed
from veridex.llm.personal_data import redacted
from veridex.llm.repetition_quality import keep_unrepetitive


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Rows are judged one by one: equal
    texts stay or go together, whatever their ids."""
    return keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id, then with the smallest hash of its
    text; null ids come last. Texts without words, nulls included, are one class. Of rows with equal id and text one
    stays."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; a null or empty text has none. Rows are judged one by one."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes labels; null texts stay null, and every row stays."""
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences; a null or empty text is its end id alone, and each row is a document."""
    return packed(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("personal data", personal), ("packing", pack)]

#: Samples, trees and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = alone(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
