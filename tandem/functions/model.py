"""Column expressions of the alignment model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.constants import NULL_PRIOR, WORD_PRIOR


def position_prior(is_null: Column, sentence_size: Column) -> Column:
    """Weight of a source word before the translation table is looked at.

    ``sentence_size`` is the number of source words the sentence holds at that
    moment: with the NULL word in training, without it in decoding.
    """
    return F.when(is_null, F.lit(NULL_PRIOR)).otherwise(
        F.lit(WORD_PRIOR) / (sentence_size + F.lit(1)))


def value_or_zero(value: Column) -> Column:
    """An absent cell reads as 0."""
    return F.coalesce(value, F.lit(0.0))


def null_safe_sum(value: Column) -> Column:
    """Sum of a column, 0 when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL instead of an error when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
