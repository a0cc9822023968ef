"""From raw documents to packed training sequences: four stages, each an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluorspark.llm import hyperminhash, langid, line_dedup, packing
from fluorspark.llm.common import table, work_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` and undecided ones go."""
    return langid.accepted(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; every document stays."""
    return line_dedup.without_repeats(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return hyperminhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of power-of-two length."""
    return packing.pack(docs)


STAGES = [("language ID", identified), ("line dedup", lines_once), ("near-duplicates", one_of_each), ("packing", packed)]

#: Language identification, sketches and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on the table ``documents``; the stages between are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
