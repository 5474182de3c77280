"""Language-model scores by Brown classes.

Words are runs of anything but ASCII white space, A-Z in lower case, and one end a
text. Every word of the training texts has one of ``CLASSES`` classes:

* the ``OWN`` - 1 most frequent words and the end by exchange clustering: in turn each
  goes to the class of best likelihood of the class bigrams, until nothing moves;
* every other word by one exchange step over all its own neighbours, with the class
  of the neighbour, or one class for all neighbours not among the frequent words.

A word's probability is the class transition, smoothed towards the class's frequency,
times the word's share of its class by absolute discounting. What the discounts of a
class leave is the unknown word's, which so has a share of every class and, as the
word before, the mean of their transitions.

Texts are read once. A task turns them into chunks: the words it met, and the texts
as positions in that list. A word is shuffled once a chunk, with the classes around
its uses; there it gets its exact count and its class, and both go back to the chunk.
A text then keeps its class bigrams, two bytes a word, which are counted for the
transitions and looked up for the score. The driver gets bigrams of the frequent
words and of classes, tables of fixed size; frequent words (a share of
1/``COMMON`` of a chunk at least) are broadcast, at most ``OWN``.

Learns from texts whose crc32(doc_id) mod 7 is not 2. Defined cases: null is the
empty text, which is the end alone; without training texts every word is unknown,
base and score are those of an empty count; words of equal gain go to the class of
least number; texts are whole, rows of one id or text count each; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, crc_of_id, id_and_text, stored

OWN, CLASSES = 1024, 48
COMMON = 1 << 16
FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 2_000_000
SLICE = 1 << 18
FLUSH = 1 << 18
END = ""
ROUNDS = 12
PRIOR = 20.0
CHUNK = "chunk long, vocab array<string>, n array<int>, ids binary, held binary, lengths binary, tokens binary"
USE = "word string, chunk long, pos int, around binary"
BACK = "chunk long, pos binary, counts binary, classes binary"
TEXTS = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
         "in_class double, steps binary")
FIRST = 128  # marks one use of each word in its class byte


def plog(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def chunks_of(docs: DataFrame) -> DataFrame:
    """Texts as positions in their chunk's list of words; ``n``: uses in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        places: dict[bytes, int] = {}
        parts, ids, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal places, parts, ids, held, size, number
            lengths = np.array([len(p) for p in parts], "<i4")
            tokens = np.concatenate(parts)
            train = np.repeat(~np.array(held), lengths)
            uses = np.bincount(tokens[train], minlength=len(places)).astype(np.int32)
            null = -(1 << 63)
            row = pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()),
                pa.array([[w.decode() for w in places]], pa.list_(pa.string())),
                pa.array([uses], pa.list_(pa.int32())),
                pa.array([np.array([null if i is None else i for i in ids], "<i8").tobytes()]),
                pa.array([np.array(held, np.uint8).tobytes()]),
                pa.array([lengths.tobytes()]), pa.array([tokens.tobytes()])],
                names(CHUNK))
            number += 1
            places, parts, ids, held, size = {}, [], [], [], 0
            return row

        for batch in batches:
            for doc_id, text, out in zip(batch.column(ID), batch.column(TEXT), batch.column("held")):
                found = text.as_py().encode().lower().split()
                found.append(END.encode())
                put = places.setdefault
                parts.append(np.array([put(w, len(places)) for w in found], "<i4"))
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                size += len(found)
                if size >= CHUNK_TOKENS:
                    yield flush()
        if parts:
            yield flush()

    return stored(id_and_text(docs).withColumn("held", crc_of_id() % FOLDS == HELD_OUT)
                  .mapInArrow(run, CHUNK), "chunks", "zstd")


class Types:
    """Numbers of the frequent words, the end first; all others share the next number."""

    def __init__(self, own: list[str]):
        self.own = {w: i for i, w in enumerate(own)}
        self.rest, self.size = len(own), len(own) + 1

    def of(self, words: list[str]) -> np.ndarray:
        find, rest = self.own.get, self.rest
        return np.fromiter((find(w, rest) for w in words), np.int64, len(words))


def frequent(chunks: DataFrame) -> Types:
    """The end and the words most used where they have 1/COMMON of a chunk's training tokens."""
    zipped = F.arrays_zip(F.col("vocab").alias("word"), F.col("n").alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda t, x: t + x)
    common = chunks.select(total.alias("total"), zipped.alias("uses")).select(F.explode(F.filter(
        "uses", lambda u: (u["n"] > 0) & (u["word"] != END) & (u["n"].cast("long") * F.lit(COMMON) >= F.col("total")))).alias("use"))
    return Types([END] + [r["word"] for r in common.groupBy(F.col("use.word").alias("word")).agg(
        F.sum("use.n").alias("n")).orderBy(F.desc("n"), "word").limit(OWN - 1).collect()])


def before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The type before each; a text starts after an end."""
    previous = np.concatenate([[0], tokens[:-1]])
    previous[np.cumsum(lengths) - lengths] = 0
    return previous


def slices(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of texts and their tokens, about SLICE tokens each, or one longer text."""
    ends = np.cumsum(lengths, dtype=np.int64)
    a = start = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, start + SLICE, "right")))
        yield slice(a, b), slice(start, int(ends[b - 1]))
        a, start = b, int(ends[b - 1])


def type_bigrams(chunks: DataFrame, types: Types) -> np.ndarray:
    """Counts of (type, next type) in training texts."""
    shared = chunks.sparkSession.sparkContext.broadcast(types)
    size = types.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                of = shared.value.of(batch.column("vocab")[r].as_py())
                lengths = np.frombuffer(batch.column("lengths")[r].as_buffer(), "<i4")
                held = np.frombuffer(batch.column("held")[r].as_buffer(), np.uint8)
                tokens = np.frombuffer(batch.column("tokens")[r].as_buffer(), "<i4")
                for texts, run_ in slices(lengths):
                    seq = of[tokens[run_]]
                    train = np.repeat(held[texts] == 0, lengths[texts])
                    pairs = before(seq, lengths[texts])[train] * size + seq[train]
                    total += np.bincount(pairs, minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["cell", "n"])

    found = (chunks.select("vocab", "lengths", "held", "tokens").mapInArrow(run, "cell int, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    total = np.zeros(size * size, np.int64)
    total[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS, rest: bool = False) -> np.ndarray:
    """A class for each type: types move to the class of best likelihood, in turn.

    The likelihood is the sum of n log n over class bigrams less that over the
    classes on their left and on their right. It never falls; ends when a round
    moves nothing. With ``rest`` the last type stands for all other words: it has the
    class ``classes`` to itself and stays there.
    """
    size = len(bigrams) - rest
    flow = (bigrams.sum(1) + bigrams.sum(0))[:size]
    order = np.argsort(-flow, kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.minimum(np.arange(size), classes - 1)
    of[order[classes:]] = np.arange(size - min(classes, size)) % classes
    if rest:
        of = np.append(of, classes)
    member = np.zeros((len(bigrams), classes + rest))
    member[np.arange(len(bigrams)), of] = 1
    counts = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not flow[w]:
                continue
            old = of[w]
            member[w, old] = 0
            right, left, self_ = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            counts[old] -= right
            counts[:, old] -= left
            counts[old, old] -= self_
            # sums with w as a neighbour, whatever its class
            rows, cols, diagonal = counts.sum(1) + left, counts.sum(0) + right, np.diag(counts)
            # gain of adding w to each class k: its row, its column, its corner, its sums
            gain = (plog(counts + right) - plog(counts)).sum(1) + (plog(counts.T + left) - plog(counts.T)).sum(1)
            gain -= plog(diagonal + right) - plog(diagonal) + plog(diagonal + left) - plog(diagonal)
            gain += plog(diagonal + right + left + self_) - plog(diagonal)
            out_, in_ = right.sum() + self_, left.sum() + self_
            gain -= plog(rows + out_) - plog(rows) + plog(cols + in_) - plog(cols)
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = int(old)
            moved += best != old
            of[w] = best
            member[w, best] = 1
            counts[best] += right
            counts[:, best] += left
            counts[best, best] += self_
        if not moved:
            break
    return of


class Around:
    """Class bigrams with all rare words in one class: what it gains to move a word out of it.

    A place beside a word has a number: the class on its left, or on its right plus
    ``CLASSES`` + 1; the last class of either side is that of the rare words, the word
    itself among them if it stands beside itself.
    """

    def __init__(self, bigrams: np.ndarray, of: np.ndarray):
        member = np.zeros((len(of), CLASSES + 1))
        member[np.arange(len(of)), of] = 1
        counts = member.T @ bigrams @ member
        self.table = np.concatenate([counts[:, :CLASSES], counts.T[:, :CLASSES]])
        self.to_rare, self.from_rare = counts[:CLASSES, CLASSES], counts[CLASSES, :CLASSES]
        self.rows, self.cols, self.corner = counts[:CLASSES].sum(1), counts[:, :CLASSES].sum(0), np.diag(counts)[:CLASSES]

    def classes(self, places: np.ndarray) -> np.ndarray:
        """The class of best likelihood for each row of counts of places; of equals the first."""
        left, right = places[:, :CLASSES], places[:, CLASSES + 1:2 * CLASSES + 1]
        words, place = np.nonzero(places)
        frequent_ = (place != CLASSES) & (place != 2 * CLASSES + 1)
        words, place = words[frequent_], place[frequent_]
        n = places[words, place].astype(float)
        gain = np.zeros((len(places), CLASSES))
        for a in range(0, len(words), FLUSH // 4):
            part = slice(a, a + FLUSH // 4)
            at = self.table[place[part]]
            starts = np.flatnonzero(np.diff(words[part], prepend=-1))
            gain[words[part][starts]] += np.add.reduceat(plog(at + n[part, None]) - plog(at), starts, axis=0)
        # the word's own uses leave the cells of the rare class
        for cell, uses, more in ((self.to_rare, left, places[:, 2 * CLASSES + 1]), (self.from_rare, right, places[:, CLASSES])):
            gain += plog(cell - uses + more[:, None]) - plog(cell - uses)
        gain += plog(self.corner + left + right) + plog(self.corner) - plog(self.corner + left) - plog(self.corner + right)
        uses = places[:, CLASSES + 1:].sum(1)[:, None]
        gain -= plog(self.rows + uses) - plog(self.rows) + plog(self.cols + uses) - plog(self.cols)
        return np.round(gain, 9).argmax(1)


def uses_of(chunks: DataFrame, types: Types, of: np.ndarray) -> DataFrame:
    """All words but the frequent ones, once a chunk, with the places beside their training uses."""
    shared = chunks.sparkSession.sparkContext.broadcast((types, of.astype(np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, of = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                vocab = batch.column("vocab")[r].values
                number = types.of(vocab.to_pylist())
                lengths, held, tokens = (np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in (
                    ("lengths", "<i4"), ("held", np.uint8), ("tokens", "<i4")))
                found = []
                for texts, run_ in slices(lengths):
                    part = tokens[run_]
                    seq = number[part]
                    side = of[seq]
                    at = np.flatnonzero((seq == types.rest) & np.repeat(held[texts] == 0, lengths[texts]))
                    left = of[before(seq, lengths[texts])[at]]
                    # a text ends in the end, so a word always has one after it
                    right = side[at + 1] + np.uint8(CLASSES + 1)
                    found += [part[at].astype(np.int64) << 8 | left, part[at].astype(np.int64) << 8 | right]
                places = np.sort(np.concatenate(found))
                rest = np.flatnonzero(number == types.rest)
                ends = np.searchsorted(places, (rest + 1) << 8)
                offsets = np.concatenate([[0], ends]).astype("<i4")
                around = pa.Array.from_buffers(pa.binary(), len(rest), [
                    None, pa.py_buffer(offsets.tobytes()), pa.py_buffer((places & 255).astype(np.uint8).tobytes())])
                for a in range(0, len(rest), 10_000):
                    part = slice(a, a + 10_000)
                    few = rest[part]
                    yield pa.RecordBatch.from_arrays([
                        vocab.take(pa.array(few)), pa.array(np.full(len(few), batch.column("chunk")[r].as_py())),
                        pa.array(few.astype(np.int32)), around[a:a + 10_000]], names(USE))

    return chunks.select("chunk", "vocab", "held", "lengths", "tokens").mapInArrow(run, USE)


def by_chunk(parts: list[tuple]) -> pa.RecordBatch:
    """Uses of many words as a row for each chunk."""
    chunk, pos, counts, classes = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(chunk, kind="stable")
    chunk, pos, counts, classes = chunk[order], pos[order], counts[order], classes[order]
    starts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
    ends = np.append(starts[1:], len(chunk))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), cut(pos.astype("<i4")), cut(counts.astype("<i8")),
                                       cut(classes.astype(np.uint8))], names(BACK))


def classified(uses: DataFrame, around: Around) -> DataFrame:
    """Count and class of every word, sent to its chunks; see ``BACK``.

    A word's rows, one a chunk, are next to each other. Of a word only its numbers of
    places and the (chunk, position) of its uses are held.
    """
    shared = uses.sparkSession.sparkContext.broadcast(around)
    places = 2 * (CLASSES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, open_, seen = None, [], np.zeros(places, np.int64)
        ready, size = [], 0

        def close(counts: np.ndarray, group: np.ndarray, chunk: np.ndarray, pos: np.ndarray) -> None:
            """Words that are complete: a row of counts each, and the uses by group."""
            nonlocal size
            n = counts[:, CLASSES + 1:].sum(1)
            classes = np.where(n > 0, shared.value.classes(counts), CLASSES)
            first = np.diff(group, prepend=-1) != 0
            ready.append((chunk, pos, n[group], classes[group] | np.where(first, FIRST, 0)))
            size += len(group)

        def close_open() -> None:
            if open_:
                chunk, pos = (np.concatenate(x) for x in zip(*open_))
                close(seen[None], np.zeros(len(chunk), np.int64), chunk, pos)

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            new = np.concatenate([[words[0].as_py() != word], pc.not_equal(
                words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]).astype(bool)
            chunk, pos = batch.column("chunk").to_numpy(), batch.column("pos").to_numpy()
            around_ = batch.column("around")
            offsets = np.frombuffer(around_.buffers()[1], "<i4")[around_.offset:around_.offset + len(around_) + 1]
            data = around_.buffers()[2]
            bytes_ = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[
                offsets[0]:offsets[-1]]
            group = np.cumsum(new) - new[0]  # 0 goes on with the open word if its first row is not new
            if new[0]:
                close_open()
                open_, seen = [], np.zeros(places, np.int64)
            groups = int(group[-1]) + 1
            counts = np.bincount(np.repeat(group, np.diff(offsets)) * places + bytes_,
                                 minlength=groups * places).reshape(groups, places)
            counts[0] += seen
            last = group == groups - 1
            if groups > 1:
                old_chunk, old_pos = (np.concatenate(x) for x in zip(*open_)) if open_ else (chunk[:0], pos[:0])
                close(counts[:-1], np.concatenate([np.zeros(len(old_chunk), np.int64), group[~last]]),
                      np.concatenate([old_chunk, chunk[~last]]), np.concatenate([old_pos, pos[~last]]))
                open_ = []
            open_.append((chunk[last].copy(), pos[last].copy()))
            seen, word = counts[-1].copy(), words[len(words) - 1].as_py()
            if size >= FLUSH:
                yield by_chunk(ready)
                ready, size = [], 0
        close_open()
        if ready:
            yield by_chunk(ready)

    return uses.repartition("word").sortWithinPartitions("word").mapInArrow(run, BACK)


class Model:
    """Numbers of the classes; of fixed size.

    ``sums``: for each class the tokens, words, words seen once and words seen twice.
    """

    def __init__(self, types: Types, of: np.ndarray, own_uses: np.ndarray, sums: np.ndarray):
        self.types, self.of, self.own_uses = types, of, own_uses
        sums = sums.copy()
        for k, c in zip(of, own_uses):
            sums[k] += (c, c > 0, c == 1, c == 2)
        self.uses, self.words, ones, twos = sums.T
        self.tokens, self.distinct = int(self.uses.sum()), int(self.words.sum())
        both = (ones > 0) & (twos > 0)
        self.discount = np.where(both, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        self.unknown = np.where(self.uses > 0, self.discount * self.words / np.maximum(self.uses, 1), 1.0)

    def in_class(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; the unknown word is a class by itself."""
        known = classes < CLASSES
        k = np.where(known, classes, 0)
        share = (counts - self.discount[k]) / np.maximum(self.uses[k], 1)
        return np.where(known, np.log10(np.where(known, share, 1.0)), 0.0)

    def steps(self, counts: np.ndarray) -> np.ndarray:
        """log10 of transitions between classes and the unknown word, from class bigrams."""
        counts = counts[:CLASSES, :CLASSES]
        share = (counts.sum(0) + 1) / (counts.sum() + CLASSES)
        step = (counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR)
        weight = share * self.unknown
        step = np.concatenate([step, (weight / weight.sum() @ step)[None]])
        return np.log10(np.concatenate([step, (step @ self.unknown)[:, None]], 1))


def class_sums(back: DataFrame) -> np.ndarray:
    """Tokens, words, words seen once, seen twice of each class, without frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1, 4), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                classes = np.frombuffer(batch.column("classes")[r].as_buffer(), np.uint8)
                c = np.frombuffer(batch.column("counts")[r].as_buffer(), "<i8")[classes >= FIRST]
                k = classes[classes >= FIRST] - FIRST
                np.add.at(total, k, np.stack([c, c > 0, c == 1, c == 2], 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1, dtype=np.int32)), *map(pa.array, total.T)],
                                         ["k", "a", "b", "c", "d"])

    sums = np.zeros((CLASSES + 1, 4), np.int64)
    for r in back.select("counts", "classes").mapInArrow(run, "k int, a long, b long, c long, d long").groupBy("k").agg(
            *[F.sum(c).alias(c) for c in "abcd"]).collect():
        sums[r["k"]] = r["a"], r["b"], r["c"], r["d"]
    return sums[:CLASSES]


def in_classes(chunks: DataFrame, back: DataFrame, model: Model) -> DataFrame:
    """Texts with all that is known before the transitions, and their class bigrams; see ``TEXTS``."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with the places of frequent words instead of the list of all words."""
        for batch in batches:
            for r in range(batch.num_rows):
                number = shared.value.types.of(batch.column("vocab")[r].as_py())
                at = np.flatnonzero(number < shared.value.types.rest)
                yield pa.RecordBatch.from_arrays([
                    batch.column("chunk").slice(r, 1), pa.array([len(number)], pa.int32()),
                    pa.array([at.astype("<i4").tobytes()]), pa.array([number[at].astype("<i4").tobytes()]),
                    *[batch.column(c).slice(r, 1) for c in names(CHUNK)[3:]]],
                    ["chunk", "size", "at", "own", *names(CHUNK)[3:]])

    def run(chunk: pd.DataFrame, uses: pd.DataFrame) -> pd.DataFrame:
        m, row, out = shared.value, chunk.iloc[0], []
        counts, classes = np.zeros(row["size"], np.int64), np.full(row["size"], CLASSES)
        at, own = np.frombuffer(row["at"], "<i4"), np.frombuffer(row["own"], "<i4")
        counts[at], classes[at] = m.own_uses[own], np.where(m.own_uses[own] > 0, m.of[own], CLASSES)
        for part in uses.itertuples():
            pos = np.frombuffer(part.pos, "<i4")
            counts[pos] = np.frombuffer(part.counts, "<i8")
            classes[pos] = np.frombuffer(part.classes, np.uint8) & (FIRST - 1)
        base = np.log10((counts + 1) / (m.tokens + m.distinct + 1))
        emit = m.in_class(counts, classes)
        end = m.of[0] if m.own_uses[0] > 0 else CLASSES
        ids, held, lengths, tokens = (np.frombuffer(row[c], kind) for c, kind in (
            ("ids", "<i8"), ("held", np.uint8), ("lengths", "<i4"), ("tokens", "<i4")))
        for texts, run_ in slices(lengths):
            size, part = lengths[texts].astype(np.int64), tokens[run_]
            ends = np.cumsum(size)
            starts, seq = ends - size, classes[part]
            previous = np.concatenate([[end], seq[:-1]])
            previous[starts] = end
            steps = (previous * (CLASSES + 1) + seq).astype("<u2")
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.where(ids[texts] == -(1 << 63), 0, ids[texts]), "Int64"),
                "held_out": held[texts] == 1, "n_tokens": size,
                "n_known": np.add.reduceat((counts[part] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base[part], starts), "in_class": np.add.reduceat(emit[part], starts),
                "steps": [steps[a:b].tobytes() for a, b in zip(starts, ends)]}))
            out[-1].loc[ids[texts] == -(1 << 63), "doc_id"] = pd.NA
        return pd.concat(out)

    schema = "chunk long, size int, at binary, own binary, ids binary, held binary, lengths binary, tokens binary"
    placed = chunks.select("chunk", "vocab", *names(CHUNK)[3:]).mapInArrow(place, schema)
    return placed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(run, TEXTS)


def class_bigrams(texts: DataFrame) -> np.ndarray:
    """Counts of (class, next class) in training texts; the last class is the unknown word."""
    size = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for steps in batch.column("steps"):
                total += np.bincount(np.frombuffer(steps.as_buffer(), "<u2"), minlength=size * size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["cell", "n"])

    total = np.zeros(size * size, np.int64)
    for r in (texts.filter("NOT held_out").select("steps").mapInArrow(run, "cell int, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).collect()):
        total[r["cell"]] = r["n"]
    return total.reshape(size, size)


def scores(docs: DataFrame) -> DataFrame:
    """One row a text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = chunks_of(docs)
    types = frequent(chunks)
    bigrams = type_bigrams(chunks, types)
    of = exchange(bigrams, rest=True)
    back = stored(classified(uses_of(chunks, types, of), Around(bigrams, of)), "classified")
    model = Model(types, of[:-1], bigrams.sum(0)[:-1], class_sums(back))
    texts = stored(in_classes(chunks, back, model), "in_classes", "zstd")
    tables = docs.sparkSession.sparkContext.broadcast(model.steps(class_bigrams(texts)).ravel())
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    tokens = model.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stepped = [tables.value[np.frombuffer(x.as_buffer(), "<u2")].sum() for x in batch.column("steps")]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in names(schema)[:4]], pa.array(np.full(batch.num_rows, tokens)),
                batch.column("base_score"), pa.array(batch.column("in_class").to_numpy() + np.array(stepped))],
                names(schema))

    return texts.mapInArrow(run, schema)
