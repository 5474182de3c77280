"""Quality by random-indexing word vectors and a two-layer network.

Every word, case folded, is a few cells: its runs of letters, digits and signs and
a mark for capitals, each hashed to ``CELLS``. A cell has a fixed sparse random
index vector. Its word vector is its own index vector plus the direction of the
sum of the index vectors found up to two places from it, over the whole corpus:
tasks sum what they read, Spark adds the sums. The table has a fixed size, so it
may be broadcast. A document is the mean and deviation of its cells' vectors and the mean
product of neighbours. A
network of one hidden layer, in numpy on the driver, learns from at most
``SAMPLE_ROWS`` labelled documents a label; a quarter of them, not learned from,
sets the temperature that makes its outputs probabilities. Both weigh a document by
how many of its label it stands for, so a score does not depend on that limit.

Labels, language, source and id are no inputs of a score. Defined cases: null is
the empty text, which has the zero vector and a score like any; without rows of
both labels to learn from, every score is 0.5; texts are read whole; equal texts
score alike; an empty table gives no rows. ``keep`` returns all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, body, crc_of_id, id_and_text
from tandem.llm.labelled import even, sample, sigmoid, temperature
from tandem.llm.words import LETTERS, WordCache, cache

CELLS, SIZE, HIDDEN, SEED = 1 << 15, 32, 24, 7
REACH = 2
SAMPLE_ROWS = 10_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
CHUNK = 1 << 18


def index_vectors() -> np.ndarray:
    """Cells x SIZE of -1, 0, 1, about an eighth of them not 0."""
    drawn = np.random.Generator(np.random.PCG64(SEED)).integers(0, 16, (CELLS, SIZE))
    return (drawn == 0).astype(np.int8) - (drawn == 1).astype(np.int8)


def cells_of(word: bytes) -> bytes:
    text = word.decode()
    found = [crc32(p.encode()) for p in LETTERS.findall(text.lower())]
    if len(text) > 1 and text.isupper():
        found.append(crc32(b"\0capitals"))
    return (np.array(found, np.uint32) & np.uint32(CELLS - 1)).astype("<i4").tobytes()


def all_cells(words: list[bytes]) -> list[bytes]:
    return [cells_of(w) for w in words]


def read_cells(words: WordCache, text: str) -> np.ndarray:
    return np.frombuffer(b"".join(words.look(text.encode().split())), "<i4")


def add_contexts(cells: np.ndarray, index: np.ndarray, total: np.ndarray, ends: np.ndarray) -> None:
    """Add to ``total`` the index vectors around each cell, within its document.

    ``ends`` has, for each cell, the number of its document.
    """
    around = np.zeros((len(cells), index.shape[1]), np.int16)
    own = index[cells]
    for d in range(1, REACH + 1):
        near = (ends[d:] == ends[:-d])[:, None]
        around[d:] += own[:-d] * near
        around[:-d] += own[d:] * near
    order = np.argsort(cells, kind="stable")
    found, first = np.unique(cells[order], return_index=True)
    total[found] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)


def contexts(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors around each cell, over all documents."""
    names = [f"v{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = cache("cells:", all_cells), index_vectors()
        total = np.zeros((CELLS, SIZE), np.int64)
        parts, held, number = [], 0, 0

        def flush() -> None:
            nonlocal parts, held
            if parts:
                add_contexts(np.concatenate(parts), index, total,
                             np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            parts, held = [], 0

        for batch in batches:
            for text in batch.column(TEXT):
                cells = read_cells(words, text.as_py())
                parts.append(cells)
                held += len(cells)
                if held >= CHUNK:
                    flush()
        flush()
        seen = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *[pa.array(total[seen, i]) for i in range(SIZE)]],
            ["cell", *names])

    sums = (id_and_text(docs).select(TEXT)
            .mapInArrow(run, "cell int, " + ", ".join(f"{n} long" for n in names))
            .groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).toArrow().to_pandas())
    total = np.zeros((CELLS, SIZE))
    total[sums["cell"].to_numpy(np.int64)] = sums[names].to_numpy(np.float64)
    return total


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Own index vector and context direction, each of length 1; common part removed."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    seen = total.any(1)
    around = unit(total)
    around[seen] -= around[seen].mean(0) if seen.any() else 0.0
    return (unit(index_vectors().astype(np.float64)) + around).astype(np.float32)


def pool(cells: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of a document's cells, and their runs.

    The last number is the mean product of neighbouring vectors, high where words
    repeat.
    """
    if not len(cells):
        return np.zeros(2 * vectors.shape[1] + 1)
    found, counts = np.unique(cells, return_counts=True)
    share = counts / counts.sum()
    mean = share @ vectors[found]
    spread = share @ (vectors[found].astype(np.float64) - mean) ** 2
    runs, last = 0.0, len(cells) - 1
    for a in range(0, last, CHUNK):  # a long text's cells in parts
        b = min(a + CHUNK, last)
        runs += float(np.einsum("ij,ij->", vectors[cells[a:b]], vectors[cells[a + 1:b + 1]]))
    return np.concatenate([mean, np.sqrt(spread), [runs / max(last, 1)]])


class Network:
    """tanh hidden layer and one logit, over standardised inputs."""

    def __init__(self, inputs: int, hidden: int = HIDDEN):
        made = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.scale, self.heat = np.zeros(inputs), np.ones(inputs), 1.0
        self.w = [made.normal(0, inputs ** -0.5, (inputs, hidden)), np.zeros(hidden),
                  made.normal(0, hidden ** -0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64,
            rate: float = 0.003, decay: float = 1e-3, weight: np.ndarray | None = None) -> None:
        """Adam on the weighted cross-entropy of logits, with weight decay."""
        weight = np.ones(len(x)) if weight is None else even(weight)
        self.mean = np.average(x, 0, weight)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, 0, weight)) + 1e-6
        x = (x - self.mean) / self.scale
        made = np.random.Generator(np.random.PCG64(SEED))
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = made.permutation(len(x))
            for a in range(0, len(x), batch):
                part = order[a:a + batch]
                w1, b1, w2, b2 = self.w
                hidden = np.tanh(x[part] @ w1 + b1)
                error = weight[part] * (sigmoid(hidden @ w2 + b2) - y[part]) / len(part)
                back = error[:, None] * w2 * (1 - hidden ** 2)
                slopes = [x[part].T @ back + decay * w1, back.sum(0),
                          hidden.T @ error + decay * w2, error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.heat)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of the whole corpus, and the network fitted on the sample."""
    vectors = word_vectors(contexts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache("cells:", all_cells)
        for batch in batches:
            pooled = [pool(read_cells(words, t.as_py()), shared.value) for t in batch.column(TEXT)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("part"), pa.array(pooled, pa.list_(pa.float64())),
                 batch.column(ID), batch.column("weight")], ["y", "part", "x", ID, "weight"])

    known = (sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)
             .mapInArrow(run, "y int, part int, x array<double>, doc_id long, weight double").toArrow().to_pandas())
    known = known.sort_values([ID, "y"], kind="stable")  # the order of rows must not matter
    x, y, weight = np.array(known["x"].tolist()), *(known[c].to_numpy(np.float64) for c in ("y", "weight"))
    learn = known["part"].to_numpy() != 0
    if len(set(y)) < 2:
        return vectors, None
    network = Network(x.shape[1])
    if all(len(set(y[part])) == 2 for part in (learn, ~learn)):
        network.fit(x[learn], y[learn], weight=weight[learn])
        network.heat = temperature(network.logits(x[~learn]), y[~learn], weight[~learn])
    else:  # too few labelled rows to set a quarter aside
        network.fit(x, y, weight=weight)
    return vectors, network


def scorer(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Column:
    """The score of a row of ``docs`` as a column over its text."""
    vectors, network = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        words = cache("cells:", all_cells)
        vectors, network = shared.value
        if network is None or not len(texts):
            return pd.Series(0.5, index=texts.index)
        pooled = np.stack([pool(read_cells(words, t), vectors) for t in texts])
        return pd.Series(network.score(pooled), index=texts.index)

    return score(body())


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    return docs.select(
        F.col(ID).cast("long").alias(ID), (crc_of_id() % FOLDS == HELD_OUT).alias("held_out"),
        scorer(docs, labels).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return docs.filter(scorer(docs, labels) >= threshold)
