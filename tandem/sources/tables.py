"""Bitexts, lines and gold links derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import words_lower
from tandem.operators.links import build_links, link_tasks
from tandem.session import spread

# A sentence id is conversation * TURNS + turn.
TURNS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(conversations: DataFrame, first_role: str, second_role: str) -> DataFrame:
    """Turns of one role with the next turn of another: ``sid, src, tgt``.

    An equi-join on (conversation, turn), which names one row, so a very long
    conversation is spread like any other.
    """
    first = conversations.filter(F.col("role") == first_role).select(
        "conv_id", "turn", F.col("text").alias("a"))
    second = conversations.filter(F.col("role") == second_role).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return first.join(second, ["conv_id", "turn"]).select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("sid"),
        words_lower(F.col("a")).alias("src"), words_lower(F.col("b")).alias("tgt"))


def training_bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn and the assistant's answer."""
    return turn_pairs(table(spark, sf_dir, "conversations"), "user", "assistant")


def held_out_bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn and the user's reaction: no pair of the training bitext."""
    return turn_pairs(table(spark, sf_dir, "conversations"), "assistant", "user")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one line in its sentence envelope: ``line, file, value``."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("doc_id").alias("line"), F.col("source").alias("file"),
        F.concat(F.lit("<s snum="), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("> "),
                 F.translate("text", "\n\r", "  "), F.lit(" </s>")).alias("value"))


def look_alike_gold(bitext: DataFrame) -> DataFrame:
    """Stand-in gold: equal words are sure, equal first two letters possible.

    Joined on (sentence, letters): positions that share nothing never meet.
    """
    tasks = link_tasks(bitext)

    def tokens(column: str, pos: str, word: str) -> DataFrame:
        return bitext.select("sid", F.posexplode(column).alias(pos, word)).withColumn(
            "letters", F.substring(word, 1, 2)).repartition(tasks, "sid", "letters")

    met = tokens("src", "e_pos", "e").join(tokens("tgt", "f_pos", "f"), ["sid", "letters"])
    return build_links(met.select("sid", "e_pos", "f_pos", (F.col("e") == F.col("f")).alias("sure")), tasks)
