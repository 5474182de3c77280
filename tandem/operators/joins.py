"""Lookups of a unique-keyed table that stay balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import TEXT_ROW_BYTES, cut_lineage, fits_broadcast, shuffle_partitions


def hot_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than 1/P of the rows, P = shuffle partitions.

    Shares above 1/P sum to at most 1, so there are fewer than P such keys.
    """
    per_key = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = big.agg(F.count(F.lit(1))).scalar()
    parts = shuffle_partitions(big.sparkSession)
    return per_key.filter(F.col("_n") * parts > total).select(*keys)


def lookup_join(big: DataFrame, table: DataFrame, keys: list[str], how: str = "inner",
                row_bytes: int = TEXT_ROW_BYTES, broadcast_limit: int | None = None) -> DataFrame:
    """Join ``big`` to a table with unique ``keys``.

    A small table is broadcast after counting it. Beyond that, rows of hot keys
    meet their few table rows by broadcast and the rest are shuffled on the key,
    so no task receives all rows of a frequent key.
    """
    limit = {} if broadcast_limit is None else {"limit": broadcast_limit}
    if fits_broadcast(table.count(), row_bytes, **limit):
        return big.join(F.broadcast(table), keys, how)
    hot = cut_lineage(hot_keys(big, keys))  # fewer rows than shuffle partitions
    hot_table = table.join(F.broadcast(hot), keys, "left_semi")
    hot_part = big.join(F.broadcast(hot), keys, "left_semi").join(
        F.broadcast(hot_table), keys, how)
    cold_part = big.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return hot_part.unionByName(cold_part)
