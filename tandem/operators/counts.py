"""Sparse count tables as rows ``e, f, n``: build, merge, normalise, overwrite."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.model import null_safe_sum, ratio, value_or_zero
from tandem.operators.blocks import ranges
from tandem.operators.cells import Part, by_source_word, on_numbers
from tandem.operators.joins import lookup_join
from tandem.session import TEXT_ROW_BYTES, cut_lineage, written

CELL = ["e", "f"]


def _types(cells: DataFrame) -> str:
    return ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in CELL)


def _kind(cells: DataFrame, value: str) -> tuple[str, type]:
    """The SQL type of sums of a value, and numpy's type of its own."""
    return ("double", np.float64) if cells.schema[value].dataType.simpleString() == "double" else ("bigint", np.int64)


def merge_counts(*tables: DataFrame, value: str = "n") -> DataFrame:
    """Cell-wise sum of count tables, by source word; a cell moves as numbers."""
    stacked = reduce(DataFrame.unionByName, [t.select(*CELL, value) for t in tables])
    if not on_numbers(stacked):
        return stacked.groupBy(*CELL).agg(F.sum(value).alias(value))

    def sums(part: Part) -> Iterator[pa.RecordBatch]:
        order, starts = part.groups()
        found = np.add.reduceat(part.values[value][order], starts)
        yield from part.rows(order[starts], **{value: (found, np.logical_or.reduceat(part.there[value][order], starts))})

    return by_source_word(stacked, sums, f"{_types(stacked)}, {value} {_kind(stacked, value)[0]}")


def increment(table: DataFrame, cells: DataFrame, value: str = "n") -> DataFrame:
    """Add amounts to single cells."""
    return merge_counts(table, cells, value=value)


def row_sums(counts: DataFrame, value: str = "n") -> DataFrame:
    """``e, sum``, materialised: small, and needed once per use of the counts.

    Partial aggregation lets a frequent ``e`` send one number per task.
    """
    return cut_lineage(counts.groupBy("e").agg(F.sum(value).alias("sum")))


def divide_rows(counts: DataFrame, sums: DataFrame, value: str = "n", name: str = "p",
                row_bytes: int = TEXT_ROW_BYTES, broadcast_limit: int | None = None) -> DataFrame:
    """Counts over their row sum; the sums travel to the counts when they fit."""
    return lookup_join(counts, sums, ["e"], row_bytes=row_bytes, broadcast_limit=broadcast_limit).select(
        *CELL, ratio(F.col(value), F.col("sum")).alias(name))


def normalize_rows(counts: DataFrame, value: str = "n", name: str = "p") -> DataFrame:
    """Every row ``e`` divided by its sum. The counts are worked out once for both, and move as numbers."""
    counts = counts.select(*CELL, value)
    if not on_numbers(counts):
        counts = written(counts, "counts")
        return divide_rows(counts, row_sums(counts, value), value, name)

    def shares(part: Part) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(part.e_words), part.values[value].dtype)
        np.add.at(sums, part.e, part.values[value])
        sums = sums.astype(float)[part.e]
        with np.errstate(all="ignore"):
            yield from part.rows(np.arange(len(part.e)), **{name: (part.values[value] / sums, part.there[value] & (sums != 0))})

    return by_source_word(counts.filter(F.col("e").isNotNull()), shares, f"{_types(counts)}, {name} double")


def lookup_cells(cells: DataFrame, table: DataFrame, value: str = "p") -> DataFrame:
    """Read cells of a table, 0 where it has none."""
    table = table.select(*CELL, value)
    stacked = cells.select(*CELL, F.lit(None).cast(table.schema[value].dataType).alias(value), F.lit(True).alias("_asked")).unionByName(
        table.select(*CELL, value, F.lit(False).alias("_asked")))
    if sorted(cells.columns) != CELL or not on_numbers(stacked, "_asked"):  # more columns are no numbers
        return cells.join(table, CELL, "left").withColumn(value, value_or_zero(F.col(value)))

    def read(part: Part) -> Iterator[pa.RecordBatch]:
        asked = part.values["_asked"]
        keys = part.e.astype(np.int64) * len(part.f_words) + part.f
        known = np.ones(len(keys), bool)  # a null word is like no other
        for words, numbers in ((part.e_words, part.e), (part.f_words, part.f)):
            known &= words.is_valid().to_numpy(zero_copy_only=False)[numbers]
        held = np.flatnonzero(~asked & known)
        held = held[np.argsort(keys[held], kind="stable")]
        at = np.flatnonzero(asked)
        first, last = (np.searchsorted(keys[held], keys[at], side) for side in ("left", "right"))
        times = np.where(known[at], last - first, 0)
        rows = np.maximum(times, 1)
        found, has = ranges(first, rows), np.repeat(times > 0, rows)
        values = np.zeros(len(found))
        values[has] = np.where(part.there[value], part.values[value], 0)[held[found[has]]]
        yield from part.rows(np.repeat(at, rows), **{value: values})

    return by_source_word(stacked, read, f"{_types(stacked)}, {value} double").select(*cells.columns, value)


def upsert_counts(base: DataFrame, updates: DataFrame, value: str = "n",
                  version: str | None = None, arrival: str | None = None) -> DataFrame:
    """Overwrite cells: the update with the highest ``version`` wins over the base.

    Of several updates of a cell in one version the one that arrived last wins:
    ``arrival`` numbers them. Without it the largest value does, so that the result is
    the same however the rows are spread.
    """
    if version is None and arrival is None:
        stacked = base.select(*CELL, value, F.lit(False).alias("_new")).unionByName(
            updates.select(*CELL, value, F.lit(True).alias("_new")))
        if on_numbers(stacked, "_new"):
            return _last_of_cells(stacked, value)
        # numbers alone, which a hash aggregation takes
        split = stacked.select(*CELL, F.when(~F.col("_new"), F.col(value)).alias("_old"), F.when(F.col("_new"), F.col(value)).alias("_value"), "_new")
        last = split.groupBy(*CELL).agg(*[F.max(c).alias(c) for c in ("_old", "_value", "_new")])
        return last.select(*CELL, F.when(F.col("_new"), F.col("_value")).otherwise(F.col("_old")).alias(value))

    def number(column: str | None) -> Column:
        return F.lit(1).cast("long") if column is None else F.col(column).cast("long")

    stacked = base.select(*CELL, value, F.lit(False).alias("_new"), F.lit(0).cast("long").alias("_v"),
                          F.lit(0).cast("long").alias("_at")).unionByName(
        updates.select(*CELL, value, F.lit(True).alias("_new"), number(version).alias("_v"), number(arrival).alias("_at")))
    last = F.max(F.struct("_new", "_v", "_at", F.col(value).alias("_value")))
    return stacked.groupBy(*CELL).agg(last.alias("_last")).select(*CELL, F.col("_last._value").alias(value))


def _last_of_cells(stacked: DataFrame, value: str) -> DataFrame:
    """The largest value of a cell's updates, marked ``_new``, or else of its other rows; a cell moves as numbers."""
    def largest(part: Part) -> Iterator[pa.RecordBatch]:
        order, starts = part.groups()
        x, new, there = part.values[value][order], part.values["_new"][order], part.there[value][order]
        counts = there & (new | ~np.repeat(np.logical_or.reduceat(new, starts), np.diff(starts, append=len(order))))
        least = -np.inf if x.dtype.kind == "f" else np.iinfo(x.dtype).min
        found = np.maximum.reduceat(np.where(counts, x, least), starts)
        yield from part.rows(order[starts], **{value: (found, np.logical_or.reduceat(counts, starts))})

    kind = stacked.schema[value].dataType.simpleString()
    made = by_source_word(stacked, largest, f"{_types(stacked)}, {value} {_kind(stacked, value)[0]}")
    return made.withColumn(value, F.col(value).cast(kind))


def with_shard(bitext: DataFrame, n_shards: int, key: str = "sid") -> DataFrame:
    """Reproducible shard number from 1, whatever the physical layout."""
    return bitext.withColumn("shard", (F.pmod(F.col(key), F.lit(n_shards)) + 1).cast("int"))


def shard_footprint(sharded: DataFrame, tokens: str = "src") -> DataFrame:
    """Per word the shards it occurs in: the copies a routed model would ship.

    The set holds at most as many numbers as there are shards.
    """
    return (
        sharded.select("shard", F.explode(F.array_distinct(tokens)).alias("e"))
        .groupBy("e").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        .withColumn("n_shards", F.size("shards"))
    )


def group_to_list(df: DataFrame, key: str, value: str, all_keys: DataFrame | None = None) -> DataFrame:
    """Values per key as a sorted list; keys of ``all_keys`` without values get an empty one."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))
    if all_keys is None:
        return lists
    return all_keys.select(key).distinct().join(lists, key, "left").select(
        key, F.coalesce("values", F.array().cast(lists.schema["values"].dataType)).alias("values"))


def total(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    return df.agg(null_safe_sum(value).alias(name))
