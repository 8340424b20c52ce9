"""A corpus pipeline over ``documents``: five stages, each one of the operators in ``tapeframe.llm``.

Every stage gets what the one before kept, written as Parquet and read again, and its
decisions take effect.  All but the last return the columns of ``documents``; ``n_chars``
follows the text.  Nulls, empty and repeated rows are handled as the operators' modules
say; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm.decontaminate import without_contaminated
from tapeframe.llm.language_id import in_known_language
from tapeframe.llm.line_dedup import without_repeated_lines
from tapeframe.llm.mixing import mix_report
from tapeframe.llm.near_dedup import one_of_each
from tapeframe.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; only those without a letter go."""
    return in_known_language(docs)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in one of them only."""
    kept = without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, words=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size, target and taken words of each document in the mix of sources."""
    return mix_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
]

# Min-max hashing and cross-parsing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
