"""Spelling variants: words one edit apart, found with grams of variable length.

1. *Words* are counted in each task, then over all, and rare ones go.
2. *Gram dictionary.* All grams of ``SHORT`` to ``LONG`` characters of the words (with
   an end mark on both sides) are counted. A gram in more than a threshold of words is
   frequent and is replaced by its extensions, one character longer; the others stay,
   and their extensions are pruned. So the frequent grams are the whole dictionary: a
   gram that starts somewhere is the shortest one there that isn't frequent. The
   threshold grows with the words, so at most ``MOST_GRAMS`` a length are frequent.
3. *Decomposition.* A word is cut into the grams that start at each position, without
   those that lie inside an earlier one.
4. *Affected grams.* For every place of an edit a word knows how many of its grams can
   change: those across the place, and those behind it that a gram from before it
   could swallow, which needs a frequent gram with the right end. The greatest such
   number is its bound; all its other grams are in any word one edit away, in their
   place or one beside.
5. *Lists.* So a word is listed under its rarest grams only, one more than its bound,
   with their place and its length. Lists are joined where gram, place and length agree
   up to the shift of one insertion; of what meets, pairs without an equal half go, and
   the others are verified by edit distance.
6. Words whose bound leaves nothing to share are listed under all their grams, and
   once more, among themselves, by fixed grams of ``SHORT`` characters, of which one
   edit cannot change all. No pair is lost.

A form is the near word with the largest count if that is twice the word's own; counts
double along a chain of forms, so chains are short and are followed by pointer doubling.

Defined cases: a null text has no words; a null id counts as the empty text before the
colon; rows are counted as they come, repeated ones too; of near words with equal
counts the smallest in code-point order is taken; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, id_and_text, stored

#: Maximal runs of Latin letters, after A-Z have become a-z.
RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 97
LETTERS, TIMES = 5, 3
SHORT, LONG = 2, 4
MOST_GRAMS = 50_000
LEAST_FREQUENT = 16
_HELD = 500_000
START, END = "^", "$"


def count_words(docs: DataFrame, every: int = EVERY, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """``word, n`` of the words to group; some runs lose a letter, as their hash says."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(ID), batch.column(TEXT)):
                known = i.as_py()
                crc = zlib.crc32(b":" if known is None else b"%d:" % known)
                for word, n in Counter(RUN.findall(text.as_py().encode().lower().decode())).items():
                    if len(word) >= letters:
                        h = zlib.crc32(word.encode(), crc)
                        if not h % every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < letters:
                                continue
                        total[word] += n
                if len(total) > _HELD:
                    yield table()
                    total.clear()
        yield table()

    return (id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= times))


class Grams:
    """The frequent grams with their counts, and what follows from them."""

    def __init__(self, counts: dict[str, int], longest: int):
        self.counts, self.longest = counts, longest
        #: Ends of the grams that are extended, without their first character.
        self.ends = {g[i:] for g in counts if len(g) < longest for i in range(1, len(g))}

    def cut(self, word: str) -> list[tuple[int, int]]:
        """Starts and ends of the grams of a word with its marks."""
        n, found, reached = len(word), [], 0
        for start in range(n - SHORT + 1):
            end = start + SHORT
            while end < n and end - start < self.longest and word[start:end] in self.counts:
                end += 1
            if end > reached:
                found.append((start, end))
                reached = end
        return found

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can take away.

        A gram is fixed by its own characters, so those before the edit stay. One
        behind it stays unless a gram that begins before or in the edit ends where
        it ends or later; all but the last character of that one is frequent.
        """
        worst = first = 0
        for i in range(1, len(word)):
            while first < len(grams) and grams[first][1] <= i:
                first += 1
            for behind in (i, i + 1) if i < len(word) - 1 else (i,):  # an insertion before i, a change of i
                lost = 0
                for start, end in grams[first:first + 2 * self.longest + 1]:
                    if start < behind or end - behind < self.longest and word[behind:end - 1] in self.ends:
                        lost += 1
                worst = max(worst, lost)
        return worst

    def listed(self, word: str) -> tuple[list[tuple[str, int]], int]:
        """The grams and places to list a word under, and how many grams any near word shares."""
        marked = START + word + END
        grams = self.cut(marked)
        shared = len(grams) - self.affected(marked, grams)
        rank = self.counts.get
        rarest = sorted((rank(marked[a:b], 0), marked[a:b], a) for a, b in grams)
        return [(g, a) for _, g, a in rarest[:len(grams) - max(shared, 1) + 1]], shared


def gram_counts(words: DataFrame, most: int = MOST_GRAMS) -> dict[str, int]:
    """Grams in so many places that at most ``most`` of a length can be: at most 3 ``most``."""
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("m"))
    places = marked.agg(F.coalesce(F.sum(F.length("m")), F.lit(0)).alias("n")).first()["n"]
    least = max(LEAST_FREQUENT, places // most)

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("m") - F.lit(size - 1))
        return F.when(F.length("m") >= size, F.transform(starts, lambda i: F.substring("m", i, size))).otherwise(
            F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of_size(size) for size in range(SHORT, LONG + 1)]))
    found = marked.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > least)
    return {r["g"]: r["n"] for r in found.collect()}


_GRAMS: dict[str, Grams] = {}


def list_words(words: DataFrame, key: str, counts: Broadcast, longest: int) -> DataFrame:
    """``gram, place, length, word, n, shared``: the lists that words are in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _GRAMS:
            _GRAMS.clear()
            _GRAMS[key] = Grams(counts.value, longest)
        grams = _GRAMS[key]
        for batch in batches:
            for a in range(0, batch.num_rows, 10_000):
                part = batch.slice(a, 10_000)
                out = []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    listed, shared = grams.listed(word)
                    out += [(g, at, len(word), word, n, shared) for g, at in listed]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)],
                    ["gram", "place", "length", "word", "n", "shared"])

    return words.select("word", "n").mapInArrow(
        run, "gram string, place int, length int, word string, n long, shared int")


def halves(less: int) -> list[Column]:
    """Hashes of the first and the second half of a word, by half the length minus ``less``."""
    cut = f"cast((length - {less}) div 2 as int)"
    return [F.expr(f"xxhash64(left(word, {cut}))").alias(f"first{less}"),
            F.expr(f"xxhash64(right(word, length - {less} - {cut}))").alias(f"second{less}")]


def meet(lists: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of words one edit apart that some list brings together.

    An edit leaves one half of the shorter word as it is, which is compared before
    the distance is worked out.
    """
    here = lists.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("length").alias("own"), "gram",
                        *halves(0), F.explode(F.array(
                            F.struct("place", "length"), F.struct("place", (F.col("length") + 1).alias("length")),
                            F.struct((F.col("place") + 1).alias("place"), (F.col("length") + 1).alias("length"))))
                        .alias("x"))
    here = here.select("a", "na", "own", "gram", "x.place", "x.length",
                       F.col("first0").alias("first"), F.col("second0").alias("second"))
    there = lists.select(F.col("word").alias("b"), F.col("n").alias("nb"), "gram", "place", "length",
                         *halves(0), *halves(1))
    half = [(F.col("first") == F.col(f"first{less}")) | (F.col("second") == F.col(f"second{less}")) for less in (0, 1)]
    return here.join(there, ["gram", "place", "length"]).filter(
        F.when(F.col("own") < F.col("length"), half[1]).otherwise((F.col("a") < F.col("b")) & half[0])).filter(
        F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def near_words(words: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, in both directions."""
    context = words.sparkSession.sparkContext
    lists = stored(list_words(words, uuid.uuid4().hex, context.broadcast(gram_counts(words, most)), LONG), "lists")
    pairs = meet(lists)
    rest = lists.filter("shared < 1").select("word", "n").distinct()
    fixed = list_words(rest, uuid.uuid4().hex, context.broadcast({}), SHORT)
    pairs = stored(pairs.unionByName(meet(fixed)).distinct(), "near")
    return pairs.selectExpr("a AS word", "na AS n", "b AS near", "nb AS near_n").unionByName(
        pairs.selectExpr("b AS word", "nb AS n", "a AS near", "na AS near_n"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the last word of their chain."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = stored(roots.join(roots.selectExpr("word AS root", "root AS next"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def group(docs: DataFrame, every: int = EVERY, letters: int = LETTERS, times: int = TIMES,
          most: int = MOST_GRAMS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``letters`` (2 or more)."""
    if letters < 2:
        raise ValueError("one edit can change all of a word of one letter")
    words = stored(count_words(docs, every, letters, times), "words")
    best = near_words(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    taken = -F.col("best.less") >= 2 * F.col("n")
    forms = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    roots = follow(forms.filter(F.col("form").isNotNull()))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
