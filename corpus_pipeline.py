"""From documents to training sequences: five stages, each an operator of tandem.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns they got. Every stage works on all that its predecessor kept, fits its
model on those of the labelled documents that are still there, and its decisions
take effect. The operators state what they do with nulls, empty and very long
texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import exact, packing, quality, simhash, toxicity
from tandem.llm.common import read_table, stored
from tandem.llm.queries import ship, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    ship(spark)
    return toxicity.keep(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of largest doc_id."""
    return exact.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of smallest doc_id.

    Near copies: SimHash fingerprints of four-word shingles that differ in at most four bits.
    """
    ship(spark)
    return simhash.keep(docs, words=simhash.WORDS, bits=simhash.BITS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality), ("toxicity", not_toxic), ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup), ("packing", packed)]

# models and token ids have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
