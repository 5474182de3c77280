"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (runs of anything but ASCII white space,
A-Z in lower case), the weight being how often a word occurs. For each of ``SAMPLES``
samples a word with weight w draws, from its own fixed numbers r, c ~ Gamma(2, 1) and
b ~ Uniform(0, 1),

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1),

and the word of least a is the sample, together with its t. The numbers come from a
generator that counts on from the word's 64-bit hash, so every distinct word has its
own, in any number, alike in every worker. Two texts agree in a
sample with a probability equal to their generalised Jaccard similarity, the sum
of the smaller over the sum of the larger weights. A fingerprint is 16 bits a
sample, in hexadecimal; likeness is the share of equal samples, corrected for
chance agreement of 16 bits.

Defined cases: null is the empty text; texts without words have the fingerprint
of zeros and are alike; whole texts count, of any length; equal texts have equal
fingerprints. ``edited`` takes rows in ascending doc_id, null first, rows of one
id by their text; the row after the last is the first; a single row follows
itself; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, id_and_text, ordered_buckets, task_count

CELLS, SAMPLES, SEED = 1 << 17, 64, 20240229
PART = 2048
SHARD_BYTES = 16 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The output step of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEPS = (np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, 1, SAMPLES)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers above 0 and below 1, exact in 32-bit floats."""
    step = np.float32(2.0 ** -23)
    return tuple((bits.astype(np.float32) + np.float32(0.5)) * step for bits in (
        (x >> np.uint64(41)).astype(np.uint32), x.astype(np.uint32) >> np.uint32(9)))


def numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each key and sample."""
    r, c, b = (halves(mixed(keys[:, None] + steps)) for steps in STEPS)
    return -np.log(r[0] * r[1]), np.log(-np.log(c[0] * c[1])), b[0]


class Known:
    """The numbers of words met before, of up to CELLS words; when full it starts anew."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.keys = np.empty(CELLS, np.uint64)
        self.table = [np.empty((CELLS, SAMPLES), np.float32) for _ in range(3)]

    def look(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys and numbers of distinct words, of no more than PART of them."""
        find = self.places.get
        at = np.array([find(w, -1) for w in words])
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.places) + len(new) > CELLS:
                self.places.clear()
                return self.look(words)
            fresh = range(len(self.places), len(self.places) + len(new))
            at[new] = fresh
            self.places.update(zip([words[i] for i in new.tolist()], fresh))
            self.keys[at[new]] = keys_of([words[i] for i in new.tolist()])
            for held, made in zip(self.table, numbers(self.keys[at[new]])):
                held[at[new]] = made
        return self.keys[at], [held[at] for held in self.table]


KNOWN: list[Known] = []


def keys_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)


def weights(text: str) -> np.ndarray:
    """How often each distinct word occurs."""
    return np.array(list(Counter(text.encode().lower().split()).values()), np.int64)


def least(counts: np.ndarray, look: Callable[[int, int], tuple]) -> np.ndarray:
    """The SAMPLES 16-bit samples; ``look`` has the keys and numbers of a range of elements."""
    if not len(counts):
        return np.zeros(SAMPLES, np.uint16)
    best, chosen = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    every = np.arange(SAMPLES)
    for a in range(0, len(counts), PART):  # a long text's words in parts
        some = counts[a:a + PART]
        keys, (r, log_c, b) = look(a, a + len(some))
        log_w = np.log(some).astype(np.float32)[:, None]
        t = np.floor(log_w / r + b)
        log_a = log_c - r * (t - b + 1)
        at = log_a.argmin(0)
        found = log_a[at, every]
        better = found < best
        best[better] = found[better]
        drawn = mixed(keys[at] + mixed(t[at, every].astype(np.int64).astype(np.uint64)))
        chosen[better] = drawn[better]
    return (chosen >> np.uint64(48)).astype(np.uint16)


def samples(counts: np.ndarray) -> np.ndarray:
    """The samples of a weighted set whose elements are positions."""
    cells = np.flatnonzero(counts)
    keys = mixed(cells.astype(np.uint64))
    return least(counts[cells], lambda a, b: (keys[a:b], numbers(keys[a:b])))


def fingerprint(text: str) -> np.ndarray:
    if not KNOWN:
        KNOWN.append(Known())
    bag = Counter(text.encode().lower().split())
    words = list(bag)
    return least(np.array(list(bag.values()), np.int64), lambda a, b: KNOWN[0].look(words[a:b]))


def as_hex(samples_: np.ndarray) -> str:
    return samples_.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    equal = float((x == y).mean())
    return max(0.0, (equal - 2.0 ** -16) / (1 - 2.0 ** -16))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_hex(fingerprint(t.as_py())) for t in batch.column(TEXT)]
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(made, pa.string())],
                                             [ID, "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows by ascending doc_id in buckets, each ending with the next one's first row.

    That row, one a bucket, has ``extra``; for the last bucket it is the first of all.
    """
    rows, buckets = ordered_buckets(id_and_text(docs), task_count(docs, SHARD_BYTES))
    rows = rows.withColumn("order_id", F.coalesce(F.col(ID), F.lit(-(1 << 63))))
    firsts = rows.groupBy("bucket").agg(F.min("order_id").alias("order_id")).collect()
    ranked = sorted((r["bucket"], r["order_id"]) for r in firsts)
    before = [(order_id, ranked[i - 1][0]) for i, (_, order_id) in enumerate(ranked)]
    tails = rows.drop("bucket").join(F.broadcast(docs.sparkSession.createDataFrame(
        before, "order_id long, bucket int")), "order_id")
    return (rows.withColumn("extra", F.lit(0)).unionByName(tails.withColumn("extra", F.lit(1)))
            .repartitionById(buckets, F.col("bucket"))
            .sortWithinPartitions("extra", "order_id", TEXT)), buckets


def edited(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likenesses.

    Edited: the last floor(n / 2) code points are replaced by the first as many
    (or all) of the next row's text.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held = None

        def close(doc_id, text, own, next_text, next_own) -> tuple:
            half = len(text) // 2
            new = text[:len(text) - half] + next_text[:half]
            new_own = fingerprint(new)
            return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_hex(own),
                    as_hex(new_own), likeness(own, new_own), likeness(own, next_own))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, [
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                    pa.float64(), pa.float64()])],
                [c.split()[0] for c in schema.split(", ")])

        ended = False
        for batch in batches:
            for doc_id, text, extra in zip(*[batch.column(c) for c in (ID, TEXT, "extra")]):
                if ended:
                    break
                doc_id, text, ended = doc_id.as_py(), text.as_py(), extra.as_py() == 1
                own = fingerprint(text)
                if held is not None:
                    done.append(close(*held, text, own))
                    if len(done) >= 2000:
                        yield flush()
                held = (doc_id, text, own)
        if done:
            yield flush()

    rows, _ = in_order(docs)
    return rows.mapInArrow(run, schema)
