"""Estimation of the lexical translation table t(f|e) by EM.

* ``shuffle`` (and ``auto``): compact blocks of sentences by target word, see
  :mod:`tandem.operators.blocks`. A round writes one bucketed table and moves one number
  per source word and block. Needs no table to fit anywhere.
* ``broadcast``: (sentence, e, f) pairs grouped by sentence, cached sorted; the table goes
  to every task in every round. Only if a bound on its size fits, else as ``shuffle``;
  the blocks that are needed then also tell the number of cells.

Both give the same result. No round adds a cell, so one size check decides for
all rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.constants import EM_ROUNDS
from tandem.functions.model import position_prior, ratio
from tandem.operators import blocks as B
from tandem.operators.cells import Part, by_source_word, on_numbers
from tandem.operators.counts import divide_rows, row_sums
from tandem.operators.pairs import (
    explode_pairs,
    null_token,
    per_target_word,
    row_bytes,
    sentence_bags,
    with_null_word,
    with_own_key,
)
from tandem.session import BROADCAST_LIMIT_BYTES, cut_lineage, fits_broadcast, shuffle_partitions

# Target words per block of the broadcast layout: a very long sentence becomes several rows.
BLOCK_WORDS = 256
GROUP = ["sid", "blk", "f"]


def pairs_fit(bags: DataFrame, cell_bytes: int, broadcast_limit: int) -> bool:
    """Whether the table may be broadcast even if every pair were a cell of its own."""
    pairs = bags.agg(F.coalesce(F.sum(F.size("src").cast("long") * F.size("tgt")), F.lit(0))).first()[0]
    return fits_broadcast(pairs, cell_bytes, broadcast_limit)


def sentence_pairs(bags: DataFrame) -> DataFrame:
    """Pairs of a sentence's block in one task, cached in the order of :data:`GROUP`."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("tgt") - 1) / BLOCK_WORDS).cast("int")),
        lambda i: F.slice("tgt", i * BLOCK_WORDS + 1, BLOCK_WORDS))
    rows = bags.filter(F.size("tgt") > 0).select(
        "sid", "len", "src", F.posexplode(chunks).alias("blk", "tgt")).repartition(
        shuffle_partitions(bags.sparkSession), "sid", "blk")
    pairs = explode_pairs(per_target_word(rows, "blk"), "blk").drop("e_pos")
    return pairs.sortWithinPartitions(*GROUP).persist(StorageLevel.MEMORY_AND_DISK)


def e_step(pairs: DataFrame, table: DataFrame, null: Column, n_null: int = 1) -> DataFrame:
    """Pairs with ``share``: the part of one ``f`` token that goes to the ``e`` tokens."""
    is_null = F.col("e") == null
    prior = position_prior(is_null, F.col("len") + F.lit(n_null))
    copies = F.when(is_null, F.col("ne") * F.lit(n_null)).otherwise(F.col("ne"))
    weighted = pairs.join(F.broadcast(table), ["e", "f"]).withColumn(  # size checked by table_fits
        "weight", F.col("p") * copies * prior)
    rivals = Window.partitionBy(*GROUP)
    return weighted.withColumn("share", ratio(F.col("weight"), F.sum("weight").over(rivals)))


def m_step(amounts: DataFrame, cell_bytes: int, broadcast_limit: int) -> DataFrame:
    """The table from amounts ``c`` per pair."""
    cells = cut_lineage(amounts.groupBy("f", "e").agg(F.sum("c").alias("c")))
    return cut_lineage(divide_rows(cells, row_sums(cells, "c"), "c",
                                   row_bytes=cell_bytes, broadcast_limit=broadcast_limit))


def train(
    bitext: DataFrame,
    rounds: int = EM_ROUNDS,
    strategy: str = "auto",
    null_growth: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    block_pairs: int = B.BLOCK_PAIRS,
) -> DataFrame:
    """Translation table ``e, f, p`` with p summing to 1 per ``e``.

    ``bitext`` has ``sid``, ``src`` and ``tgt``; pairs may share a ``sid``. Each
    sentence gets the NULL word once; with ``null_growth`` round k sees it k+1 times.
    """
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    null, cell_bytes = null_token(bitext), row_bytes(bitext)
    bags = with_null_word(sentence_bags(with_own_key(bitext)), null).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if strategy != "broadcast" or not pairs_fit(bags, cell_bytes, broadcast_limit):
            laid = B.make_blocks(bags, null, block_pairs)
            if strategy != "broadcast" or not fits_broadcast(laid.n_cells(), cell_bytes, broadcast_limit):
                bags.unpersist()  # the blocks hold all of it, and the rounds want the memory
                return B.train_blocks(laid, rounds, null_growth)
            laid.tables.drop()
        pairs = sentence_pairs(bags)
        table = m_step(pairs.withColumn("c", (F.col("ne") * F.col("nf")).cast("double")), cell_bytes, broadcast_limit)
        for k in range(1, rounds + 1):
            expected = e_step(pairs, table, null, k + 1 if null_growth else 1)
            table = m_step(expected.withColumn("c", F.col("nf") * F.col("share")), cell_bytes, broadcast_limit)
        pairs.unpersist()
        return table.select("e", "f", "p")
    finally:
        bags.unpersist()


def posterior(bitext: DataFrame, table: DataFrame, strategy: str = "auto",
              broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Share of every source word in explaining every target word, one E step."""
    null = null_token(bitext)
    keyed = with_own_key(bitext)
    bags = with_null_word(sentence_bags(keyed), null).join(keyed.select("sid", "given_sid"), "sid")
    bags = bags.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        laid = B.make_blocks(bags, null)
    finally:
        bags.unpersist()

    def work(block: B.Block, row: dict):
        p = B.given_values(block, row)
        known = B.known_cells(block, row)
        for units, unit, at, cell, sentence, share in block.shares(p, 1):
            there = known[cell]
            sid, e, f, ne, nf, share = (x[there] for x in (
                sentence[unit], block.src[at], block.tgt[units][unit], block.n_src[at],
                block.n_tgt[units][unit], share))
            yield pa.RecordBatch.from_arrays([
                block.given_sid.take(pa.array(sid)), row["e"].values.take(pa.array(e)),
                row["f"].values.take(pa.array(f)), pa.array(ne, pa.int32()), pa.array(nf, pa.int32()), pa.array(share, from_pandas=True)],
                ["sid", "e", "f", "ne", "nf", "share"])

    routed = B.route_table(laid, table, strategy, row_bytes(bitext), broadcast_limit)
    shares = B.over_blocks(
        routed, work, f"sid {keyed.schema['given_sid'].dataType.simpleString()}, e {laid.e_type}, f {laid.f_type}, ne int, nf int, share double")
    laid.tables.forget()
    return shares


def _most_likely(part: Part, n: int) -> Iterator[pa.RecordBatch]:
    """The first ``n`` cells of every word: no number counts as the least, NaN as the most, as Spark orders them."""
    p, there = part.values["p"], part.there["p"]
    place = np.empty(len(part.f_words), np.int64)
    place[pc.sort_indices(part.f_words, null_placement="at_start").to_numpy()] = np.arange(len(place))
    order = np.lexsort((place[part.f], -np.where(np.isnan(p), 0, p), ~np.isnan(p), ~there, part.e))
    starts = np.flatnonzero(np.diff(part.e[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) + 1
    order, rank = order[rank <= n], rank[rank <= n]
    yield from part.rows(order, p=(p[order], there[order]), rank=rank.astype(np.int32))


def top_translations(table: DataFrame, n: int) -> DataFrame:
    """The ``n`` most likely target words of every source word, ties by ``f``."""
    if sorted(table.columns) == ["e", "f", "p"] and on_numbers(table):
        types = [f"{c} {table.schema[c].dataType.simpleString()}" for c in table.columns]
        made = by_source_word(table.withColumn("p", F.col("p").cast("double")), lambda part: _most_likely(part, n),
                              "e {}, f {}, p double, rank int".format(*[table.schema[c].dataType.simpleString() for c in ("e", "f")]))
        return made.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in types], "rank")
    best = Window.partitionBy("e").orderBy(F.desc("p"), "f")
    return table.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
