"""From raw documents to packed token ids, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, language, mixing, packing, simhash
from nearfield.llm.scratch import remove
from nearfield.session import scratch_path, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter (null and empty texts too) or far from every language go.

    Equal rows are judged alike and all stay or go. Rows without ``lang`` are judged, not learned from.
    """
    ship_package(spark)
    return language.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the lowest id.

    Texts without a word are copies of one another. Rows that repeat an id are one
    document; rows without an id all stay.
    """
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A null or empty text, or item, holds none; equal rows all stay or go.
    """
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the production mixture, once per epoch that takes them.

    A null text has no tokens; rows without language or source are a leaf of
    their own; rows that share an id, or have none, go together.
    """
    ship_package(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    A null or empty text is its end only; equal rows are packed as often as they
    occur. Of equally tight rows the earliest is filled.
    """
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", packed),
]

ORACLE_SQL = None  # learned languages and tokenizers are beyond SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each is written to the shared folder and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
