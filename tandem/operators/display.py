"""Display forms of sentence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import numbered_words


def format_pair(bitext: DataFrame) -> DataFrame:
    """``sid, text``: numbered source words, then numbered target words, a line each."""
    return bitext.select("sid", F.concat(
        numbered_words(F.col("src")), F.lit("\n"), numbered_words(F.col("tgt")), F.lit("\n")
    ).alias("text"))
