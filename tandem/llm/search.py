"""Ranked lexical search by scanning documents with an automaton of the items' terms.

An Aho-Corasick automaton holds every term of every item, each between two blanks,
and goes to all tasks. A text whose separators are blanks is fed through it whole, so
a match is a term and nothing longer, and what the automaton puts out is counted: the
term frequencies, straight from the text. A term's number leads to the items that
have it. Nothing is kept of the documents: the first scan adds up how many there
are, their length and in how many of them each term occurs, the second one scores.

A task keeps the best documents of each item it has seen and hands on only these;
they are ranked in two steps, dealt by a hash of the id and then whole. The items
are taken in groups of at most ``GROUP_BYTES`` of text, which bounds the automaton;
an item beyond that is a group of its own.

Defined cases: a null text has no terms; rows of one item_id are one item, with the
terms of all its texts (a null id is an id like others); an item without terms gets
no rows; documents of equal score rank by doc_id, null last, and rows of one doc_id
are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heappushpop
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, id_and_text

TOP = 10
GROUP_BYTES = 32 << 20
#: Share of a document's length in its weight, in percent.
LENGTH_SHARE = 90
#: Documents scored at once.
BATCH = 128
SALTS = 64
SCHEMA = f"item_id long, rank int, {ID} long, score long"
#: ASCII letters to lower case, all other ASCII but digits to blanks.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def plain(text: str) -> bytes:
    """Terms as they are compared, with blanks between them."""
    return text.encode().translate(_TABLE)


class Terms:
    """The terms of some items: ``items`` of term t are postings[starts[t]:starts[t + 1]]."""

    def __init__(self, items: list[list[str]]):
        found = [sorted(set(b" ".join(map(plain, texts)).decode().split(" ")) - {""}) for texts in items]
        self.words = sorted(set().union(*found))
        number = {w: i for i, w in enumerate(self.words)}
        pairs = np.array([(number[w], i) for i, words in enumerate(found) for w in words], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.postings = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
        self.n_items = len(items)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for i, word in enumerate(self.words):
            made.add_word(f" {word} ", i)
        made.make_automaton()
        return made


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton_of(key: str, terms: Terms) -> ahocorasick.Automaton:
    """This worker's automaton; that of the last group of items goes."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = terms.automaton()
    return _AUTOMATA[key]


def counts(text: str, automaton: ahocorasick.Automaton) -> tuple[int, Counter]:
    """How many terms a text has, and how often each one of the items'."""
    line = plain(text)
    return len(line.split()), Counter(map(itemgetter(1), automaton.iter(f" {line.decode()} ")))


def statistics(docs: DataFrame, key: str, shared: Broadcast) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their length together, and documents of each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(key, shared.value)
        held = np.zeros(len(shared.value.words) + 2, np.int64)
        for batch in batches:
            for text in batch.column(TEXT):
                n, found = counts(text.as_py(), automaton)
                held[0] += n > 0
                held[1] += n
                held[np.fromiter(found, np.int64, len(found)) + 2] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["k", "n"])

    sums = np.zeros(len(shared.value.words) + 2, np.int64)
    for row in docs.select(TEXT).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sums[row["k"]] = row["n"]
    return int(sums[0]), int(sums[1]), sums[2:]


class Best:
    """The best ``top`` documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a score below cannot enter

    def add(self, ids: list, scores: np.ndarray) -> None:
        for d, i in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            heap, one = self.heaps[i], (int(scores[d, i]), ids[d] is not None, -(ids[d] or 0))
            if len(heap) < self.top:
                heappush(heap, one)
            else:
                heappushpop(heap, one)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]


def best_of_tasks(docs: DataFrame, key: str, shared: Broadcast, weights: np.ndarray,
                  n_docs: int, length: int, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents that each task has for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, automaton = shared.value, automaton_of(key, shared.value)
        best = Best(terms.n_items, top)
        uses = np.diff(terms.starts)

        def score(part: pa.RecordBatch) -> np.ndarray:
            scores = np.zeros((part.num_rows, terms.n_items), np.int64)
            rows, words, gains = [], [], []
            for d, text in enumerate(part.column(TEXT)):
                n, found = counts(text.as_py(), automaton)
                if found:
                    word = np.fromiter(found, np.int64, len(found))
                    tf = np.fromiter(found.values(), np.int64, len(found))
                    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // length
                    rows.append(np.full(len(word), d))
                    words.append(word)
                    gains.append(weights[word] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))
            if rows:
                row, word, gain = map(np.concatenate, (rows, words, gains))
                times = uses[word]
                which = np.repeat(np.arange(len(word)), times)
                item = terms.postings[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                                      + terms.starts[word][which]]
                np.add.at(scores.reshape(-1), row[which] * terms.n_items + item, gain[which])
            return scores

        size = max(1, min(BATCH, 4_000_000 // max(1, terms.n_items)))
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                best.add(part.column(ID).to_pylist(), score(part))
        out = [(i, -x if known else None, s) for i, heap in enumerate(best.heaps) for s, known, x in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["item", ID, "score"])

    return docs.mapInArrow(run, f"item long, {ID} long, score long")


def rank_group(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The best documents of some items (rows of item_id and texts)."""
    spark = docs.sparkSession
    key, terms = uuid.uuid4().hex, Terms([r["texts"] for r in items])
    if not terms.words:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(terms)  # of items of at most GROUP_BYTES, or of one
    n_docs, length, held = statistics(docs, key, shared)
    weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    found = best_of_tasks(docs, key, shared, weights, n_docs, length, top)
    order = [F.desc("score"), F.asc_nulls_last(ID)]
    found = found.withColumn("salt", F.pmod(F.xxhash64(ID), F.lit(SALTS)))
    for by in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(
            F.col("rank") <= top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", ID, "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    docs = id_and_text(docs)
    grouped = items.select(F.col("item_id").cast("long").alias("item_id"),
                           F.coalesce(F.col(TEXT).cast("string"), F.lit("")).alias(TEXT)).groupBy("item_id").agg(
        F.collect_list(TEXT).alias("texts")).withColumn("bytes", F.expr(
            "aggregate(texts, 0L, (n, t) -> n + octet_length(t))"))
    size = grouped.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-2 * size // group_bytes)) if size > group_bytes else 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = []
    for g in range(groups):
        group = grouped.filter(part == g).orderBy("item_id").select("item_id", "texts").collect()
        if group:
            found.append(rank_group(docs, group, top))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame(
        [], SCHEMA)
