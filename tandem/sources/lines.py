"""Text lines with their file and line number, read in parallel blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.session import TEXT_ROW_BYTES, cut_lineage, fits_broadcast


def read_lines(spark: SparkSession, paths: str | list[str],
               file_pattern: str | None = None) -> DataFrame:
    """All lines below ``paths`` (plain or compressed by extension, UTF-8).

    ``file_pattern`` prunes files by path before any is opened. ``_mid`` rises
    with the line inside a file block, which is what :func:`number_lines`
    builds on.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(paths)
    if file_pattern is not None:
        text = text.filter(F.col("_metadata.file_path").rlike(file_pattern))
    return (
        text.select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_mid"),
        )
    )


def dataset_of(file: str) -> str:
    """The dataset of a file name: itself, or the folder of part files it is in."""
    return re.sub(r"/part-[^/]*$", "", file)


def number_lines(lines: DataFrame, dataset_pattern: str | None = None) -> DataFrame:
    """Adds ``dataset``, ``line_no`` (1-based in the dataset), ``ordinal`` (1-based
    over all datasets in name order) and ``block_row`` (0-based in the block).

    A dataset is a file, or a directory of part files such as Spark writes:
    ``dataset_pattern`` extracts its name from the file path. Lines are not
    moved: one pass counts lines per block, a second adds the block's offset.
    """
    if dataset_pattern is None:
        dataset = F.regexp_replace("file", r"/part-[^/]*$", "")
    else:
        dataset = F.regexp_extract("file", dataset_pattern, 1)
    part_no = F.coalesce(
        F.nullif(F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1), F.lit("")).cast("long"),
        F.lit(0))
    blocks = cut_lineage(
        lines.groupBy("file", "block")
        .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("file", "block", "_first", "_n", dataset.alias("dataset"), part_no.alias("_part")))
    # One row per file block (split), so these windows stay at metadata size.
    order = ["_part", "file", "block"]
    in_dataset = (Window.partitionBy("dataset").orderBy(*order)
                  .rowsBetween(Window.unboundedPreceding, -1))
    overall = (Window.orderBy("dataset", *order)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(
        "file", "block", "_first", "_n", "dataset",
        F.coalesce(F.sum("_n").over(in_dataset), F.lit(0)).alias("_in_dataset"),
        F.coalesce(F.sum("_n").over(overall), F.lit(0)).alias("_overall"))
    if fits_broadcast(blocks.count(), 2 * TEXT_ROW_BYTES):
        offsets = F.broadcast(offsets)
    row = F.col("_mid") - F.col("_first")
    # splits may be packed otherwise in this pass; then rows fall outside their block
    checked = F.when((row >= 0) & (row < F.col("_n")), row).otherwise(
        F.raise_error(F.lit("file blocks changed between passes")).cast("long"))
    return (
        lines.join(offsets, ["file", "block"], "left")
        .withColumn("block_row", checked.cast("long"))
        .withColumn("line_no", F.col("_in_dataset") + F.col("block_row") + 1)
        .withColumn("ordinal", F.col("_overall") + F.col("block_row") + 1)
        .select("dataset", "file", "block", "block_row", "line_no", "ordinal", "value")
    )


def accepted(rows: DataFrame, ok: Column, message: Column, strict: bool) -> DataFrame:
    """Rows that are ``ok``; another row is an error if ``strict``, else left out."""
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(ok)


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``dataset, line_no, value`` of every line."""
    return number_lines(read_lines(spark, paths)).select("dataset", "line_no", "value")
