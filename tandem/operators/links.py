"""Alignment links as rows: ``sid, e_pos, f_pos, sure``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.session import shuffle_partitions

KEYS = ["sid", "e_pos", "f_pos"]
# Position pairs of sentences of which one task holds the links at most, as far as links are spread evenly.
TASK_PAIRS = 4_000_000


def link_tasks(bitext: DataFrame) -> int:
    """Tasks for the links of a bitext, by its position pairs. Links are small once compressed, so that tasks
    dealt by stored bytes get more of them the more there are."""
    def words(side: str) -> Column:
        return F.greatest(F.size(side), F.lit(0)).cast("long")

    pairs = bitext.agg(F.coalesce(F.sum(words("src") * words("tgt")), F.lit(0))).first()[0]
    return max(shuffle_partitions(bitext.sparkSession), -(-pairs // TASK_PAIRS))


def build_links(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per link. Links with a negative position are dropped; a link given
    as possible and as sure is sure. ``tasks`` of them, if given, whatever the bytes."""
    rows = rows.filter("e_pos >= 0 and f_pos >= 0")
    return (
        (rows.repartition(tasks, *KEYS) if tasks else rows)
        .groupBy(*KEYS).agg(F.max("sure").alias("sure"))
    )


def invalid_links(rows: DataFrame) -> DataFrame:
    return rows.filter("e_pos < 0 or f_pos < 0")


def reverse_links(links: DataFrame) -> DataFrame:
    """Source and target positions swapped; sure stays sure."""
    return links.select("sid", F.col("f_pos").alias("e_pos"), F.col("e_pos").alias("f_pos"), "sure")


def links_for_source(links: DataFrame, e_pos: int) -> DataFrame:
    """Sure links of one source position in every sentence."""
    return links.filter(F.col("sure") & (F.col("e_pos") == e_pos)).select(*KEYS)


def sure_links(links: DataFrame) -> DataFrame:
    return links.filter("sure").select(*KEYS)


def link_membership(links: DataFrame, gold: DataFrame) -> DataFrame:
    """For every proposed link: is it a sure, a possible gold link?

    The join key is the link itself, so it is spread evenly.
    """
    marked = gold.select(*KEYS, F.col("sure").alias("gold_sure"))
    return links.select(*KEYS).join(marked, KEYS, "left").select(
        *KEYS,
        F.coalesce("gold_sure", F.lit(False)).alias("in_sure"),
        F.col("gold_sure").isNotNull().alias("in_possible"),
    )


def link_intersection(links: DataFrame, gold: DataFrame, sure_only: bool = False) -> DataFrame:
    """Proposed links that are also gold."""
    wanted = gold.filter("sure") if sure_only else gold
    return links.select(*KEYS).intersect(wanted.select(*KEYS))
