"""Vocabulary with first-seen ids, and encoding of text to ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.joins import lookup_join
from tandem.operators.order import running_total, with_global_index
from tandem.session import (
    BROADCAST_LIMIT_BYTES, TEXT_ROW_BYTES, cut_lineage, fits_broadcast, shuffle_partitions)

# Source side first, then the target side, as two files one after the other.
_TGT_LINE = 1 << 62
# Tokens of a block of lines that are looked up together, by one look-up a distinct word.
BLOCK_TOKENS = 2_000_000


def line_words(lines: DataFrame, words: Column, line: str = "line") -> DataFrame:
    """``line, pos, word``, one row per token."""
    return lines.select(F.col(line).alias("line"), F.posexplode(words).alias("pos", "word"))


def bitext_lines(bitext: DataFrame) -> DataFrame:
    """Both sides of a bitext as lines in first-seen order: ``line, words``.

    Pairs count in reading order, ``pair_no``, if they have it, else by ``sid``.
    """
    order = F.col("pair_no" if "pair_no" in bitext.columns else "sid")
    return bitext.select(order.alias("line"), F.col("src").alias("words")).unionByName(
        bitext.select((order + F.lit(_TGT_LINE)).alias("line"), F.col("tgt").alias("words")))


def first_seen(lines: DataFrame, words: Column, line: str = "line") -> DataFrame:
    """``word, line, pos`` of every word's first appearance.

    Repeats inside a line are removed in the row, so (line, word) is unique and
    the minimum is a plain hash aggregation with map-side combining.
    """
    distinct = lines.select(
        F.col(line).alias("_line"), F.posexplode(F.array_distinct(words)).alias("_pos", "word"))
    return distinct.groupBy("word").agg(
        F.min("_line").alias("line"), F.min_by("_pos", "_line").alias("pos"))


def first_seen_vocab(lines: DataFrame, words: Column, line: str = "line") -> DataFrame:
    """``word, id``: dense ids from 1 in order of first appearance.

    ``line`` is a number that orders the lines of all files.
    """
    return (
        with_global_index(first_seen(lines, words, line), "line", "pos", name="id", start=1)
        .select("word", F.col("id"))
    )


def vocab_fits(vocab: DataFrame, broadcast_limit: int | None) -> bool:
    limit = BROADCAST_LIMIT_BYTES if broadcast_limit is None else broadcast_limit
    return fits_broadcast(vocab.count(), TEXT_ROW_BYTES, limit)


def _by_row(rows: DataFrame, key: str, fits: bool) -> DataFrame:
    """Rows spread by their key, when their tokens will stay with them.

    With a broadcast vocabulary this is the only shuffle: it moves compact rows,
    and the tokens are looked up and put together again where they are.
    """
    return rows.repartition(shuffle_partitions(rows.sparkSession), key) if fits else rows


def encode_lines(lines: DataFrame, words: Column, vocab: DataFrame, line: str = "line",
                 broadcast_limit: int | None = None) -> DataFrame:
    """``line, ids``: words replaced by their ids, in order; lines without any are left out.

    Beyond a broadcast, lines are looked up by blocks, see :func:`encode_rows`.
    """
    if vocab_fits(vocab, broadcast_limit):
        tokens = line_words(_by_row(lines, line, True), words, line)
        looked_up = lookup_join(tokens, vocab, ["word"], broadcast_limit=broadcast_limit)
        grouped = looked_up.groupBy("line").agg(
            F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_t"))
        return grouped.select("line", F.transform("_t", lambda t: t["id"]).alias("ids"))
    return encode_rows(lines.withColumnRenamed(line, "line"), words, vocab).filter(
        F.col("first") & (F.size("ids") > 0)).select("line", "ids")


def encode_rows(rows: DataFrame, words: Column, vocab: DataFrame, *carry: Column,
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``line``, the columns ``carry``, the ``ids`` of the words, and whether a row is the ``first`` of its line.

    Lines are dealt over blocks by their number. A block asks for each of its distinct words
    once, so that lines are exchanged as they are and no token is, and a frequent word has one row a block. Rows of one
    ``line`` share a block; each gets the ids of all of them, by position, then id.
    """
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.size(words), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    n = max(shuffle_partitions(rows.sparkSession), -(-total // block_tokens))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("line"), F.lit(n)).cast("int")).repartition(n, "block")
    wanted = dealt.select("block", F.explode(words).alias("word")).distinct()
    found = wanted.join(vocab.select("word", "id"), "word").select(F.col("block").alias("of"), "word", "id")
    dealt = dealt.select("block", "line", words.alias("words"), *carry)
    kept = [f for f in dealt.schema if f.name not in ("block", "words")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ids array<long>, first boolean"

    def encode(lines: pa.Table, known: pa.Table) -> pa.Table:
        return _encode(lines, known, [f.name for f in kept])

    return dealt.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(encode, schema)


def _encode(lines: pa.Table, known: pa.Table, kept: list[str]) -> pa.Table:
    lines, known = lines.combine_chunks(), known.combine_chunks()
    words = lines.column("words").combine_chunks() if len(lines) else pa.array([], lines.schema.field("words").type)
    code = lines.column("line").combine_chunks().dictionary_encode("encode").indices.to_numpy() if len(lines) else np.empty(0, int)
    found = pc.index_in(words.flatten(), value_set=known.column("word"))
    there = found.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    row = np.repeat(np.arange(len(lines)), sizes)[there]
    ids = known.column("id").to_numpy()[found.drop_null().to_numpy()]
    n = int(code.max(initial=-1)) + 1
    if n < len(lines):  # rows that share their line
        pos = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))[there]
        row, ids = code[row], ids[np.lexsort((ids, pos, code[row]))]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int64())).cast(pa.list_(pa.int64()))
    first = np.zeros(len(lines), bool)
    first[np.unique(code, return_index=True)[1]] = True
    return pa.table([*[lines.column(c) for c in kept], lists.take(pa.array(code)), pa.array(first)], [*kept, "ids", "first"])


def encode_bitext(bitext: DataFrame, vocab: DataFrame,
                  broadcast_limit: int | None = None) -> DataFrame:
    """The bitext with ids instead of words; words outside the vocabulary get -1."""
    def side(column: str, is_tgt: bool) -> Column:
        return F.transform(column, lambda w, i: F.struct(
            F.lit(is_tgt).alias("t"), i.alias("pos"), w.alias("word")))

    def known(column: str) -> Column:
        """A NULL side counts as empty."""
        return F.coalesce(column, F.array().cast("array<string>"))

    # a number of its own keeps pairs of one sid apart; it is fixed by writing it down
    keyed = cut_lineage(bitext.select(
        F.monotonically_increasing_id().alias("_pair"), "sid", known("src").alias("src"), known("tgt").alias("tgt")))
    rows = _by_row(keyed, "_pair", vocab_fits(vocab, broadcast_limit))
    tokens = rows.select(
        "_pair", "sid", F.explode_outer(F.concat(side("src", False), side("tgt", True))).alias("x")
    ).select("_pair", "sid", "x.t", "x.pos", "x.word")
    ids = lookup_join(tokens, vocab, ["word"], how="left", broadcast_limit=broadcast_limit)
    item = F.struct("pos", F.coalesce("id", F.lit(-1)).cast("int").alias("id"))
    # of a pair without words, the one token is NULL and belongs to no side
    sides = ids.groupBy("_pair", "sid").agg(
        F.array_sort(F.collect_list(F.when(~F.col("t"), item))).alias("src"),
        F.array_sort(F.collect_list(F.when(F.col("t"), item))).alias("tgt"))
    return sides.select("sid", F.transform("src", lambda x: x["id"]).alias("src"),
                        F.transform("tgt", lambda x: x["id"]).alias("tgt"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("n_words"))


def vocab_growth(tokens: DataFrame, file: str = "file", word: str = "word") -> DataFrame:
    """Distinct words after each file, files in order: ``file, n_new, n_words``.

    ``file`` should be a number: its minimum is then a hash aggregation.
    """
    new_words = (
        tokens.groupBy(word).agg(F.min(file).alias("file"))
        .groupBy("file").agg(F.count(F.lit(1)).alias("n_new")))
    files = tokens.select(F.col(file).alias("file")).distinct()
    counted = files.join(new_words, "file", "left").select(
        "file", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return running_total(cut_lineage(counted), "file", "n_new", "n_words")
