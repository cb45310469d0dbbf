"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, best-fit packing; each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlight.llm import exact_dedup, language, packing, simhash
from weftlight.llm.common import crc_fold, tokenizer_path, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language model (operator 3) finds a language.

    Texts that are null or hold no letter go, and texts of eight words or more of which no language of the model has 0.4.
    The model learns from the labelled documents outside the held-out fold; labels decide nothing else, and without any
    every text with a letter stays. Repeated rows fare alike; further columns of any name are kept; an empty table gives
    no row.
    """
    return language.recognised(docs, language.fit(docs.filter(crc_fold(docs["doc_id"], 5) != 0)))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays (operator 9).

    Null and empty texts are equal; a null id stays only if its group has no other; of rows that repeat id and text one
    stays; further columns of any name are kept; an empty table gives no row.
    """
    return exact_dedup.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the smallest id stays (operator 8).

    Texts without words are alike; repeated and null ids, repeated rows and columns of any name are allowed; an empty table
    gives no row.
    """
    return simhash.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids from all documents left (operator 4); a row per piece.

    Null and empty texts are the end id alone; repeated rows are packed like any others; further columns are dropped; an
    empty table gives no row.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup), ("packing", pack)]

#: Language ID, fingerprints and tokenizers have no SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
