"""Readers of sentence pairs, with their checks as report frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.constants import SRC_EXT, TGT_EXT
from tandem.functions.text import sgml_id, sgml_words, split_single_whitespace
from tandem.operators.order import skip_take
from tandem.session import TEXT_ROW_BYTES, fits_broadcast
from tandem.sources.lines import accepted, number_lines, read_lines


# --- one file of `e e e | f f f` lines of ids -------------------------------

def pipe_lines(spark: SparkSession, paths: str | list[str],
               max_per_split: int | None = None) -> DataFrame:
    """Numbered raw lines; ``max_per_split`` keeps the first lines of each input split."""
    lines = number_lines(read_lines(spark, paths))
    if max_per_split is not None:
        lines = lines.filter(F.col("block_row") < max_per_split)
    return lines.select(F.col("ordinal").alias("sid"), "value")


def parse_pipe(lines: DataFrame) -> DataFrame:
    """Adds ``src``, ``tgt`` (NULL where the field is absent or not all ids) and ``ok``."""
    fields = F.split("value", r"\|")

    def ids(field: Column) -> Column:
        return split_single_whitespace(field).try_cast("array<int>")

    def clean(column: str) -> Column:
        return F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())

    return (
        lines.withColumn("src", ids(F.get(fields, 0)))
        .withColumn("tgt", ids(F.get(fields, 1)))
        .withColumn("ok", clean("src") & clean("tgt"))
    )


def read_pipe_bitext(spark: SparkSession, paths: str | list[str],
                     max_per_split: int | None = None, strict: bool = True) -> DataFrame:
    """``sid, src array<int>, tgt array<int>``; fields after the second are ignored.

    A malformed line is an error, or left out if not ``strict``.
    """
    return accepted(parse_pipe(pipe_lines(spark, paths, max_per_split)), F.col("ok"),
                    # names the line by number, so that lines left out by max_per_split are not judged
                    F.concat(F.lit("bad pair line "), F.col("sid").cast("string"), F.lit(": "), F.col("value")),
                    strict).select("sid", "src", "tgt")


def pipe_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that hold no well-formed pair of id lists."""
    return parse_pipe(pipe_lines(spark, paths)).filter("not ok").select("sid", "value")


# --- parallel files base.en / base.fr ---------------------------------------

def side_pattern(ext: str) -> str:
    """Paths of a side's files; the first group is the base."""
    return rf"^(.*)\.{re.escape(ext)}(?:\.gz)?(?:/part-[^/]*)?$"


def side_lines(spark: SparkSession, sources: str | list[str], ext: str) -> DataFrame:
    """``source_idx, base, line_no, value`` of all files ``*.ext`` of the sources.

    ``base.ext`` may be a file or a directory of part files; ``.gz`` may follow.
    """
    sources = [sources] if isinstance(sources, str) else list(sources)
    pattern = side_pattern(ext)
    read = None
    for idx, source in enumerate(sources):
        numbered = number_lines(read_lines(spark, source, pattern), pattern).select(
            F.lit(idx).alias("source_idx"), F.col("dataset").alias("base"), "line_no", "value")
        read = numbered if read is None else read.unionByName(numbered)
    return read


def zip_lines(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """n-th line with n-th line. The keys name one line each, so no key is hot."""
    return left.join(right, keys, how)


def line_counts(src_lines: DataFrame, tgt_lines: DataFrame) -> DataFrame:
    """Lines per base on either side, and how many pair up."""
    keys = ["source_idx", "base"]
    n_src = src_lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_src"))
    n_tgt = tgt_lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tgt"))
    return (
        n_src.join(n_tgt, keys, "full_outer")
        .select(*keys, F.coalesce("n_src", F.lit(0)).alias("n_src"),
                F.coalesce("n_tgt", F.lit(0)).alias("n_tgt"))
        .withColumn("n_pairs", F.least("n_src", "n_tgt"))
    )


def line_count_report(src_lines: DataFrame, tgt_lines: DataFrame) -> DataFrame:
    """Bases whose two files differ in length; the surplus lines are not paired."""
    return line_counts(src_lines, tgt_lines).filter("n_src <> n_tgt")


def paired_lines(src_lines: DataFrame, tgt_lines: DataFrame, offset: int = 0,
                 limit: int | None = None) -> DataFrame:
    """Line pairs with ``pair_no``, their number in reading order over all bases.

    ``offset`` and ``limit`` count pairs. As the counts of the bases tell every
    line's number, lines outside the window go before the sides meet.
    """
    counts = line_counts(src_lines, tgt_lines)
    before = (Window.orderBy("source_idx", "base")  # one row per file
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        "source_idx", "base", F.coalesce(F.sum("n_pairs").over(before), F.lit(0)).alias("_start"))
    if fits_broadcast(counts.count(), TEXT_ROW_BYTES):
        starts = F.broadcast(starts)
    number = F.col("_start") + F.col("line_no")

    def inside(lines: DataFrame) -> DataFrame:
        kept = number > offset
        if limit is not None:
            kept = kept & (number <= offset + limit)
        return lines.join(starts, ["source_idx", "base"]).filter(kept)

    src, tgt = inside(src_lines), tgt_lines
    if offset or limit is not None:
        tgt = inside(tgt_lines).drop("_start")
    pairs = zip_lines(src.withColumnRenamed("value", "src_line"), tgt.withColumnRenamed("value", "tgt_line"),
                      ["source_idx", "base", "line_no"])
    return pairs.withColumn("pair_no", number).drop("_start")


def parse_pairs(pairs: DataFrame) -> DataFrame:
    """Words and ids of both lines. Pairs without an id get minus their number."""
    own = sgml_id(F.col("src_line"))
    return pairs.select(
        F.when(own == -1, -F.col("pair_no")).otherwise(own).alias("sid"),
        "source_idx", F.col("base").alias("source_file"), "line_no", "pair_no",
        sgml_words(F.col("src_line")).alias("src"),
        sgml_words(F.col("tgt_line")).alias("tgt"),
        own.alias("src_id"), sgml_id(F.col("tgt_line")).alias("tgt_id"),
    )


def id_mismatches(parsed: DataFrame) -> DataFrame:
    """Pairs whose two lines carry different ids; see ``strict`` of the readers."""
    return parsed.filter("src_id <> tgt_id").select(
        "source_file", "line_no", "src_id", "tgt_id")


def duplicate_ids(bitext: DataFrame) -> DataFrame:
    """Sentence ids used more than once, with their number of uses."""
    return bitext.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accept_pairs(bitext: DataFrame, where: Column | str | None = None) -> DataFrame:
    """Keep the pairs a predicate accepts; all of them without one."""
    return bitext if where is None else bitext.filter(where)


def _same_ids(parsed: DataFrame, strict: bool) -> DataFrame:
    return accepted(parsed, F.col("src_id") == F.col("tgt_id"), F.concat(
        F.lit("ids differ in "), F.col("source_file"), F.lit(", line "), F.col("line_no").cast("string")), strict)


def _read_pairs(src_lines: DataFrame, tgt_lines: DataFrame, where: Column | str | None, offset: int,
                limit: int | None, strict: bool) -> DataFrame:
    """Accepted pairs in a window of reading order.

    Where every pair counts, the window is one of line numbers, and only its lines
    are paired and checked; else the ends are found among the accepted pairs.
    """
    if where is None and strict:
        kept = _same_ids(parse_pairs(paired_lines(src_lines, tgt_lines, offset, limit)), strict)
    else:
        kept = accept_pairs(_same_ids(parse_pairs(paired_lines(src_lines, tgt_lines)), strict), where)
        if offset or limit is not None:
            kept = skip_take(kept, "pair_no", offset=offset, limit=limit)
    return kept.select("sid", "source_idx", "source_file", "line_no", "pair_no", "src", "tgt")


def read_paired_bitext(
    spark: SparkSession,
    sources: str | list[str],
    src_ext: str = SRC_EXT,
    tgt_ext: str = TGT_EXT,
    where: Column | str | None = None,
    offset: int = 0,
    limit: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Pairs of all ``base.src_ext`` / ``base.tgt_ext`` of the source directories.

    Sources are read in the given order, their files in name order. ``where``
    sees the parsed columns; ``offset`` and ``limit`` count accepted pairs. A pair
    whose lines carry unlike ids is an error, or left out if not ``strict``.
    """
    return _read_pairs(side_lines(spark, sources, src_ext), side_lines(spark, sources, tgt_ext),
                       where, offset, limit, strict)


def read_bitext_files(
    spark: SparkSession,
    src_path: str,
    tgt_path: str,
    where: Column | str | None = None,
    limit: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Pairs of two named files; lines of unlike ids are an error if ``strict``."""
    def numbered(path: str) -> DataFrame:
        return number_lines(read_lines(spark, path)).select(
            F.lit(0).alias("source_idx"), F.lit("").alias("base"), "line_no", "value")

    return _read_pairs(numbered(src_path), numbered(tgt_path), where, 0, limit, strict)


def empty_sources(bitext: DataFrame, n_sources: int) -> DataFrame:
    """Numbers of the sources that gave no pair."""
    wanted = bitext.sparkSession.range(n_sources).select(F.col("id").cast("int").alias("source_idx"))
    return wanted.join(bitext.select("source_idx").distinct(), "source_idx", "left_anti")


def ordered_pairs(bitext: DataFrame) -> DataFrame:
    """Reading order: source, file name, line."""
    return bitext.orderBy("source_idx", "source_file", "line_no")


def pair_count(bitext: DataFrame) -> DataFrame:
    return bitext.agg(F.count(F.lit(1)).alias("n_pairs"))


def reverse_bitext(bitext: DataFrame) -> DataFrame:
    """Source and target swapped."""
    others = [c for c in bitext.columns if c not in ("src", "tgt")]
    return bitext.select(*others, F.col("tgt").alias("src"), F.col("src").alias("tgt"))
