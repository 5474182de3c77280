"""Set and bag operations with explicit order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.unionByName(b).distinct()


def concat_ordered(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, with the number of the part as ``part_idx``."""
    return reduce(DataFrame.unionByName,
                  [p.withColumn("part_idx", F.lit(i)) for i, p in enumerate(parts)])


def flatten_two_level(df: DataFrame, values: Column, key: str, name: str = "value") -> DataFrame:
    """For every key its values one after the other: ``key, pos, name``."""
    return df.select(key, F.posexplode(values).alias("pos", name))


def with_position(df: DataFrame, tokens: str, *carry: str) -> DataFrame:
    """One row per token with its 0-based position."""
    return df.select(*carry, F.posexplode(tokens).alias("pos", "token"))


def union_in_row(left: Column | str, right: Column | str) -> Column:
    """The distinct elements of two arrays of a row, the left one's first."""
    return F.array_union(left, right)


def total_in_row(numbers: Column | str) -> Column:
    """Sum of a row's array, 0 for an empty or NULL one."""
    return F.coalesce(F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long"))


def sorted_in_row(items: Column | str, *keys: Callable[[Column], Column], reverse: bool = False) -> Column:
    """An array of a row in the order of derived keys, compared one after the other.

    A key is any expression of an element; the comparison that Spark is given looks at
    a later key only where the earlier ones are equal. ``keys`` should end in one that
    tells elements apart, or equal ones stand in any order.
    """
    def compare(a: Column, b: Column) -> Column:
        result = F.lit(0)
        for key in reversed(keys):
            result = F.when(key(a) < key(b), F.lit(-1)).when(key(a) > key(b), F.lit(1)).otherwise(result)
        return -result if reverse else result

    return F.array_sort(items, compare)
