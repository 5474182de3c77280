"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, toxic and ordinary, give a word's probability character by character
from the ``ORDER - 1`` before it. Each has its own counts of the longest n-grams,
in how many documents of its class a word occurs; below that both back off to the
same continuation counts, over the n-grams of both. So an expression that is rare
in either class gets the shared probability in both and decides nothing, and a
new word is judged by the parts it shares with known ones. A text is compared by
the differences of its words' log-likelihoods, normalised by its length (see
``statistics``); a logistic curve over them, fitted on a quarter of the sample that
was not counted, makes a probability. It weighs a document by how many of its label
it stands for; the models are of one class each and need no weights.

The models come from at most ``SAMPLE_ROWS`` labelled documents a class, counted
by Spark; their size is bounded by the sample. Labels, language, source and id are
no inputs of a score. Defined cases: null is the empty text, which counts as one
word of difference 0; if the quarter set aside or the rest has one label only, the
whole sample takes its place; without rows of both labels to learn from every score is 0.5; texts
are read whole; equal texts score alike; an empty table gives no rows. ``keep``
returns all columns, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, body, crc_of_id, stored
from tandem.llm.labelled import logistic, sample, sigmoid
from tandem.llm.words import LETTERS, cache

ORDER = 7
START, END = "\x02", "\x03"
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7


def parts_of(word: str) -> list[str]:
    return LETTERS.findall(word.lower())


def grams(part: str) -> list[str]:
    """The n-grams of ORDER characters that spell a part, its end included."""
    line = START * (ORDER - 1) + part + END
    return [line[i:i + ORDER] for i in range(len(line) - ORDER + 1)]


def count_grams(rows: DataFrame) -> DataFrame:
    """``gram`` with its count in ordinary (``n0``) and toxic (``n1``) documents."""
    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(TEXT), batch.column("y")):
                y = y.as_py()
                for part in {p for w in set(text.as_py().split()) for p in parts_of(w)}:
                    counts.setdefault(part, [0, 0])[y] += 1
            if len(counts) > 500_000:
                yield table(counts)
                counts = {}
        yield table(counts)

    def by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part, n0, n1 in zip(*[batch.column(c).to_pylist() for c in ("w", "n0", "n1")]):
                for g in grams(part):
                    held = counts.setdefault(g, [0, 0])
                    held[0] += n0
                    held[1] += n1
            if len(counts) > 500_000:
                yield table(counts)
                counts = {}
        yield table(counts)

    def table(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts, pa.string()), *[pa.array([n[k] for n in counts.values()], pa.int64())
                                              for k in (0, 1)]], ["w", "n0", "n1"])

    schema, sums = "w string, n0 long, n1 long", [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    words = rows.select(TEXT, "y").mapInArrow(by_word, schema).groupBy("w").agg(*sums)
    return words.mapInArrow(by_gram, schema).groupBy("w").agg(*sums).withColumnRenamed("w", "gram")


def absolute_discount(table: DataFrame, count: str) -> float:
    """n1 / (n1 + 2 n2), one half where there is none of either."""
    r = table.agg(F.count_if(F.col(count) == 1).alias("ones"), F.count_if(F.col(count) == 2).alias("twos")).first()
    return r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] and r["twos"] else 0.5


def history() -> Column:
    return F.expr("left(gram, length(gram) - 1)")


def tail() -> Column:
    return F.expr("substring(gram, 2)")


def shared_backoff(grams_: DataFrame) -> DataFrame:
    """P(last character | those before it) of all n-grams below the longest, as ``gram, p``.

    Kneser-Ney by continuation counts: the count of an n-gram is the number of
    distinct characters found before it, in both classes together.
    """
    levels = [grams_.select("gram")]
    for _ in range(ORDER - 1):
        levels.append(stored(levels[-1].groupBy(tail().alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), "continuations"))
    below = None
    for level in reversed(levels[1:]):
        d = absolute_discount(level, "n")
        sums = level.groupBy(history().alias("h")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        joined = level.withColumn("h", history()).join(sums, "h")
        if below is None:
            joined = joined.withColumn("q", F.lit(1.0 / (level.count() + 1)))
        else:
            joined = joined.withColumn("t", tail()).join(
                below.select(F.col("gram").alias("t"), F.col("p").alias("q")), "t")
        below = stored(joined.select("gram", (
            (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("q")) / F.col("total"))
            .alias("p")), "backoff")
    return below


def compile_model(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of n-grams and histories, and log ratios toxic to ordinary.

    That of an n-gram is the ratio of its probabilities, that of a history the
    ratio of what the classes leave to the shared counts: an n-gram seen in neither
    has that of its history, as the shared probability is the same for both.
    """
    sums = counts.groupBy(history().alias("h")).agg(
        *[F.sum(f"n{y}").alias(f"t{y}") for y in (0, 1)],
        *[F.count_if(F.col(f"n{y}") > 0).alias(f"k{y}") for y in (0, 1)])
    d = [absolute_discount(counts, f"n{y}") for y in (0, 1)]
    left = [F.when(F.col(f"t{y}") > 0, d[y] * F.col(f"k{y}") / F.col(f"t{y}")).otherwise(1.0) for y in (0, 1)]
    share = [F.when(F.col(f"t{y}") > 0, F.greatest(F.col(f"n{y}") - d[y], F.lit(0.0)) / F.col(f"t{y}"))
             .otherwise(0.0) for y in (0, 1)]
    shared = shared_backoff(counts).select(F.col("gram").alias("t"), F.col("p").alias("q"))
    of_grams = (counts.withColumn("h", history()).join(sums, "h").withColumn("t", tail()).join(shared, "t")
                .select("gram", F.log(
                    (share[1] + left[1] * F.col("q")) / (share[0] + left[0] * F.col("q"))).alias("ratio")))
    of_histories = sums.select(F.col("h").alias("gram"), F.log(left[1] / left[0]).alias("ratio"))
    found = of_grams.unionByName(of_histories).withColumn("ratio", F.col("ratio").cast("float")).toArrow()
    if not found.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    texts, ratios = found["gram"].to_pylist(), found["ratio"].to_numpy().astype(np.float64)
    codes, size = code_points(texts)
    begins = np.cumsum(size) - size
    keys = np.where(size == ORDER, gram_keys(codes, ORDER)[begins], gram_keys(codes, ORDER - 1)[begins])
    order = np.argsort(keys, kind="stable")
    return keys[order], ratios[order]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters one after the other, and how many each text has."""
    return (np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"),
            np.fromiter(map(len, texts), np.int64, len(texts)))


def gram_keys(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters from each place on, as if blanks followed the end."""
    padded = np.concatenate([codes, np.full(size, 32, np.uint32)]).astype(np.uint64)
    h = np.full(len(codes), size, np.uint64)
    for k in range(size):
        h = (h ^ padded[k:k + len(codes)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def find(model: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the keys, 0 where there is none, and where there is one."""
    known, ratios = model
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[at] == keys
    return np.where(there, ratios[at], 0.0), there


def word_ratios(words: list[bytes], model: tuple[np.ndarray, np.ndarray]) -> list[float]:
    """The difference of a word's log-likelihoods, for several words, each added up by itself."""
    parts = [parts_of(w.decode()) for w in words]
    lines = [START * (ORDER - 1) + part + END for found in parts for part in found]
    if not lines:
        return [0.0] * len(words)
    codes, size = code_points(lines)
    size -= ORDER - 1  # n-grams of a part
    begins = np.cumsum(size + ORDER - 1) - size - ORDER + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(begins - ends + size, size)
    value, there = find(model, gram_keys(codes, ORDER)[at])
    unseen = np.flatnonzero(~there)
    value[unseen] = find(model, gram_keys(codes, ORDER - 1)[at[unseen]])[0]
    of_parts = np.add.reduceat(value, ends - size).tolist()
    out, next_part = [], iter(of_parts)
    for found in parts:
        out.append(sum((next(next_part) for _ in found), 0.0))
    return out


def statistics(text: str, words) -> list[float]:
    """What the curve is fitted on: log-likelihood differences, normalised by length.

    Toxic texts are ordinary but for some words, so besides the mean of all words
    (each within -1 and 8, as one word must not outweigh the rest) there are the
    mean of the fiftieth of the words with the largest, the shares of words above
    2 and 4, and how many there are.
    """
    found = np.array(words.look(text.encode().split()) or [0.0])
    top = max(1, -(-len(found) // 50))
    return [float(np.clip(found, -1, 8).mean()), float(np.partition(found, -top)[-top:].mean()),
            float((found > 2).mean()), float((found > 4).mean()), log(len(found) + 1),
            float(min((found > 3).sum(), 4))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """Tables of the two models and the weights of the logistic curve."""
    chosen = sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    for counted in (chosen.filter("part <> 0"), chosen):  # of few labelled rows, none is set aside
        counts = stored(count_grams(counted), "grams")
        uses = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n0", "n1")]).first()
        if uses["n0"] and uses["n1"]:
            break
    else:
        return "", None, None
    model = compile_model(counts)
    key = f"ratios:{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache(key, lambda words_: word_ratios(words_, shared.value))
        for batch in batches:
            x = [statistics(t.as_py(), words) for t in batch.column(TEXT)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID), batch.column("y"), batch.column("weight"),
                 pa.array(x, pa.list_(pa.float64()))], [ID, "y", "weight", "x"])

    def read(rows: DataFrame) -> pd.DataFrame:
        found = rows.mapInArrow(run, "doc_id long, y int, weight double, x array<double>").toArrow().to_pandas()
        return found.sort_values([ID, "y"], kind="stable")

    known = read(chosen.filter("part = 0"))
    if known["y"].nunique() < 2:  # few labelled rows: the curve is fitted on those that were counted, too
        known = read(chosen)
    y, weight = (known[c].to_numpy(np.float64) for c in ("y", "weight"))
    x = np.array(known["x"].tolist())
    scale = np.maximum(np.sqrt(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight)), 1e-9)
    weights = logistic(x / scale, y, weight=weight)
    weights[:-1] /= scale
    return key, shared, weights


def scorer(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Column:
    """The score of a row of ``docs`` as a column over its text."""
    key, shared, weights = fit(docs, labels, rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if weights is None or not len(texts):
            return pd.Series(0.5, index=texts.index)
        words = cache(key, lambda words_: word_ratios(words_, shared.value))
        x = np.array([statistics(t, words) for t in texts])
        return pd.Series(sigmoid(x @ weights[:-1] + weights[-1]), index=texts.index)

    return score(body())


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    return docs.select(
        F.col(ID).cast("long").alias(ID), (crc_of_id() % FOLDS == HELD_OUT).alias("held_out"),
        scorer(docs, labels).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return docs.filter(scorer(docs, labels) < threshold)
