"""Sentence pairs as bags of words, and the (sentence, e, f) pairs they span."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.constants import NULL_ID, NULL_WORD
from tandem.operators import blocks as B
from tandem.session import FIXED_ROW_BYTES, TEXT_ROW_BYTES, shuffle_partitions, written


def _is_text(bitext: DataFrame) -> bool:
    return isinstance(bitext.schema["src"].dataType.elementType, T.StringType)


def null_token(bitext: DataFrame) -> Column:
    """The NULL word in the token type of the bitext."""
    if _is_text(bitext):
        return F.lit(NULL_WORD)
    return F.lit(NULL_ID).cast(bitext.schema["src"].dataType.elementType)


def row_bytes(bitext: DataFrame) -> int:
    return TEXT_ROW_BYTES if _is_text(bitext) else FIXED_ROW_BYTES


def append_null(bitext: DataFrame) -> DataFrame:
    """The NULL word added once at the end of every source sentence."""
    return bitext.withColumn("src", F.array_append("src", null_token(bitext)))


def with_own_key(bitext: DataFrame) -> DataFrame:
    """``sid`` replaced by a number of the pair's own; ``given_sid`` keeps the old one.

    Files that number their sentences from 1 share ids, and a pair is a pair
    whatever its id. The numbers are fixed by writing the pairs down.
    """
    return written(bitext.select(
        F.monotonically_increasing_id().alias("sid"), F.col("sid").alias("given_sid"), "src", "tgt"), "pairs")


def sentence_bags(bitext: DataFrame) -> DataFrame:
    """``sid, len, src, tgt`` with distinct words, their counts and first positions.

    Working on distinct words keeps token multiplicity as a factor instead of
    repeated rows. One shuffle of the sentences; ``sid`` must be unique, see
    :func:`with_own_key`. A NULL side counts as empty.
    """
    def side(column: str, is_tgt: bool) -> Column:
        return F.transform(column, lambda w, i: F.struct(
            F.lit(is_tgt).alias("t"), w.alias("w"), i.alias("pos")))

    n = shuffle_partitions(bitext.sparkSession)
    tokens = (
        bitext.repartition(n, "sid")
        .select("sid", *[F.coalesce(c, F.array().cast(bitext.schema[c].dataType)).alias(c) for c in ("src", "tgt")])
        .select("sid", F.size("src").alias("len"),
                F.explode(F.concat(side("src", False), side("tgt", True))).alias("x"))
        .select("sid", "len", "x.t", "x.w", "x.pos")
    )
    words = tokens.groupBy("sid", "len", "t", "w").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("pos").alias("pos"))
    return words.groupBy("sid", "len").agg(
        F.collect_list(F.when(~F.col("t"), F.struct("w", "n", "pos"))).alias("src"),
        F.collect_list(F.when(F.col("t"), F.struct("w", "n"))).alias("tgt"),
    )


def with_null_word(bags: DataFrame, null: Column) -> DataFrame:
    """The NULL word in every source bag, at position -1."""
    one = F.struct(null.alias("w"), F.lit(1).alias("n"), F.lit(-1).alias("pos"))
    return bags.withColumn("src", F.array_append("src", one))


def explode_pairs(rows: DataFrame, *carry: str) -> DataFrame:
    """One row per source word of rows that hold one target word ``f``."""
    return (
        rows.select(*carry, "sid", "len", "f", "nf", F.explode("src").alias("x"))
        .select(*carry, "sid", "len", "f", "nf", F.col("x.w").alias("e"),
                F.col("x.n").alias("ne"), F.col("x.pos").alias("e_pos"))
    )


def per_target_word(bags: DataFrame, *carry: str) -> DataFrame:
    return (
        bags.select(*carry, "sid", "len", "src", F.explode("tgt").alias("y"))
        .select(*carry, "sid", "len", "src", F.col("y.w").alias("f"), F.col("y.n").alias("nf"))
    )


def cooccurrence_of_bags(bags: DataFrame) -> DataFrame:
    pairs = explode_pairs(per_target_word(bags))
    return pairs.groupBy("e", "f").agg(
        F.sum((F.col("ne") * F.col("nf")).cast("long")).alias("n"))


def cooccurrence(bitext: DataFrame, with_null: bool = True) -> DataFrame:
    """How often ``e`` and ``f`` stand in the same pair, counting tokens: ``e, f, n``.

    By blocks, which hold all pairs of their cells: words are exchanged, no pairs.
    """
    null = null_token(bitext)
    bags = sentence_bags(with_own_key(bitext))
    bags = (with_null_word(bags, null) if with_null else bags).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        laid = B.make_blocks(bags, null)
    finally:
        bags.unpersist()
    counts = B.cell_counts(laid)
    laid.tables.forget()
    return counts
