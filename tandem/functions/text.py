"""Column expressions on raw lines: tokenizers, SGML tags, display forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence envelope `<s snum=0001> … </s>`.
OPEN_TAG = "<s"
CLOSE_TAG = "</s>"
ID_PREFIX = "snum="
_ID_PATTERN = r"(?:^|\s)snum=(-?\d+)>(?=\s|$)"
_ID_TOKEN = r"^snum=-?\d+>$"
_PREFIX_PATTERN = r"^<s\s+snum=-?\d+>\s"
_SUFFIX_PATTERN = r"^\s</s>$"
_SUFFIX_CHARS = 5


def split_spaces(line: Column) -> Column:
    """Split on single blanks: inner repeats give empty words, trailing ones none."""
    body = F.rtrim(line)
    only_blanks = (body == "") & (line != "")
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(F.split(body, " "))


def split_single_whitespace(line: Column) -> Column:
    """Trim, then split on every single whitespace character."""
    return F.split(trim_whitespace(line), r"\s")


def split_whitespace(line: Column) -> Column:
    """Trim, then split on runs of whitespace (the usual tokenizer)."""
    return F.split(trim_whitespace(line), r"\s+")


def trim_whitespace(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def words_lower(text: Column) -> Column:
    """Lower-cased whitespace tokens, without empty ones."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sgml_id(line: Column) -> Column:
    """Sentence id of a tagged line, -1 when it has none."""
    digits = F.nullif(F.regexp_extract(line, _ID_PATTERN, 1), F.lit(""))
    return F.coalesce(digits.cast("long"), F.lit(-1).cast("long"))


def sgml_words(line: Column) -> Column:
    """Words of a line without the sentence tags and the id token.

    A word glued to the tag makes no id token, so the line is not taken as tagged
    and all of it stays.
    """
    return F.filter(
        split_whitespace(line),
        lambda w: (w != OPEN_TAG) & (w != CLOSE_TAG) & ~w.rlike(_ID_TOKEN))


def has_envelope(line: Column) -> Column:
    """Tags on both ends; plain lines are told apart without a pattern match."""
    return (line.startswith(OPEN_TAG) & line.endswith(CLOSE_TAG)
            & F.right(line, F.lit(_SUFFIX_CHARS)).rlike(_SUFFIX_PATTERN) & line.rlike(_PREFIX_PATTERN))


def envelope_prefix(line: Column) -> Column:
    return F.when(has_envelope(line), F.regexp_extract(line, _PREFIX_PATTERN, 0)).otherwise("")


def envelope_suffix(line: Column) -> Column:
    return F.when(has_envelope(line), F.right(line, F.lit(_SUFFIX_CHARS))).otherwise("")


def envelope_body(line: Column) -> Column:
    start = F.length(F.regexp_extract(line, _PREFIX_PATTERN, 0))
    inner = F.substring(line, start + 1, F.length(line) - start - _SUFFIX_CHARS)
    return F.when(has_envelope(line), inner).otherwise(line)


def numbered_words(words: Column) -> Column:
    """``0:word 1:word …`` with a trailing blank, as pairs are displayed."""
    return F.array_join(
        F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w, F.lit(" "))), "")


def map_tokens(words: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply a column function to every token."""
    return F.transform(words, fn)
