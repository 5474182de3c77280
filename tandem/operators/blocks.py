"""Sentence pairs in compact blocks, and the model's work on them.

Sentences go to the blocks in messages: of some million words at a time, what one block needs
of them, as compressed arrays with the distinct words beside them.

A block holds the target words of one bucket with the sentences they are in: word
lists with offsets, never a row per (sentence, e, f). Pairs exist only as numpy arrays
of a few sentences at a time, while a task goes through a block. With a block goes its
need list: the distinct source words and the distinct cells (e, f) that its pairs use.
What a block does not own is routed to it by that list:

* the total of a source word, in training, one number a word and block. The words are
  dealt into n parts; block and part exchange one array, added up by the part's index
  of the words of every block;
* the whole count of a cell of a *cut* word, a target word with over 1/n of all pairs
  (n = blocks; fewer than n words), whose sentences are dealt over several blocks: one
  more number in the array of its source word's part;
* the cells of a given table, for alignment and posteriors, as arrays by their target words.

The cells of all other words belong to one block, and their counts stay there. Most of
them have a single pair. Such a cell's probability is a product of factors of its unit (a
target word of a sentence) and of its source word, one of each a round, so a state keeps
these two products and the counts of the other, *shared* cells. The state of a round is a
table bucketed by block like the blocks themselves, so that the join of a round finds
both in one place by their layout, whatever the session's settings.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tandem.constants import NULL_PRIOR, WORD_PRIOR
from tandem.session import (
    BROADCAST_LIMIT_BYTES, fits_broadcast, release, remove_path, scratch_path, shuffle_partitions)

# (sentence, e, f) pairs of a block, and of those that are worked out at once.
BLOCK_PAIRS = 8_000_000
STEP_PAIRS = 500_000
# Words of the sentences that are dealt to the blocks at once.
DEALT_WORDS = 2_000_000
# Cells of a given table that go to a block, or are looked up there, at once.
ROUTED_CELLS = 1_000_000
# Powers of 2 of which two may be multiplied without loss.
FAR_POWER = 450


class Tables:
    """Bucketed tables of one computation, dropped with their files by :meth:`drop`."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n
        self.key, self.held = uuid.uuid4().hex, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` bucketed and sorted by ``block``, read back from its files."""
        return self.write_by(df, name, "block")

    def write_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        table, path = f"tandem_{name}_{self.key}", scratch_path(self.spark, name)
        df.write.bucketBy(self.n, key).sortBy(key).option("path", path).saveAsTable(table)
        self.held[name] = table, path
        return self.spark.table(table)

    def forget(self) -> None:
        """Take the tables out of the catalog; frames made of them still read their files."""
        for table, _ in self.held.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def drop(self, *names: str) -> None:
        for name in names or list(self.held):
            if name in self.held:
                table, path = self.held.pop(name)
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                remove_path(self.spark, path)


def scaled(x, more=0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as fractions from 0.5 and powers of 2, whose products neither overflow nor underflow."""
    fraction, power = np.frexp(x)
    return fraction, (power + more).astype(np.int32)


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that has them all."""
    least, most = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kinds = (np.iinfo(f"{sign}int{bits}") for bits in (8, 16, 32, 64) for sign in ("u", ""))
    return x.astype(next(kind.dtype for kind in kinds if kind.min <= least and most <= kind.max))


def packed(parts: tuple) -> bytes:
    """A block's arrays as bytes, compressed: a row of them is copied several times on its way to a task."""
    payload = pickle.dumps(parts, 5)
    return len(payload).to_bytes(8, "little") + pa.compress(payload, "zstd", asbytes=True)


def unpacked(payload: bytes | pa.Buffer) -> tuple:
    payload = memoryview(payload)
    return pickle.loads(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd"))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def added(numbers: np.ndarray, amounts: np.ndarray, n: int) -> np.ndarray:
    """Sums of the amounts by number below ``n``, some at a time: counting by numbers copies both."""
    total = np.zeros(n)
    for a in range(0, len(numbers), 2 * STEP_PAIRS):
        total += np.bincount(numbers[a:a + 2 * STEP_PAIRS], amounts[a:a + 2 * STEP_PAIRS], n)
    return total


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every task."""
    if not pa.types.is_string(words.type):
        words = words.fill_null(0)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def products(fraction: np.ndarray, power: np.ndarray, row: np.ndarray, unit: np.ndarray, unit_power: np.ndarray) -> np.ndarray:
    """Each unit's number times those of its row of places, all as fractions and powers of 2.

    Powers of a row are taken from its largest, which goes to the units, if all then fit in doubles.
    """
    top = power.max(1, initial=-FAR_POWER, where=fraction != 0)
    own, more = power - top[:, None], unit_power + top[row]
    if (np.where(fraction != 0, own, 0) < -FAR_POWER).any() or (np.abs(np.where(unit != 0, more, 0)) > FAR_POWER).any():
        return np.ldexp(fraction[row] * unit[:, None], power[row] + unit_power[:, None])
    return np.ldexp(fraction, own)[row] * np.ldexp(unit, more)[:, None]


class Block:
    """One block's sentences: lists of word numbers with offsets, and its shared cells."""

    def __init__(self, payload: bytes | pa.Buffer):
        # counts and positions stay as narrow as they come: there is one of each a place of ``src``
        (self.sid, self.given_sid, self.size, self.src_off, self.src, self.n_src, self.pos, self.tgt_off, self.tgt, self.n_tgt,
         self.n_e, self.null, self.is_shared, self.place, self.shared, self.cut, self.cut_no) = unpacked(payload)

    @cached_property
    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All cells in order, those of single pairs too; the places of the shared ones and of the pairs' own among them."""
        single = [keys[~shared] for *_, keys, shared, _ in self.pairs()]
        keys = np.concatenate([self.shared, *single])
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        return keys[order], place[:len(self.shared)], place[len(self.shared):]

    @property
    def cells(self) -> np.ndarray:
        return self.layout[0]

    def steps(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Some units (target words of a sentence) at a time, with all their pairs.

        Yields the units, their first pairs, and of each pair its unit, its place in
        ``src`` and its cell.
        """
        _, of_shared, of_single = self.layout
        before = 0
        for units, first, unit, at, sentence, keys, shared, place in self.pairs():
            cell = np.empty(len(keys), np.int32)
            cell[shared] = of_shared[place]
            n = len(keys) - len(place)
            cell[~shared] = of_single[before:before + n]
            before += n
            yield units, first, unit, at, cell, sentence

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """As :meth:`steps`, but of each pair the cell's key, whether it is shared, and the shared ones' places."""
        before = placed = 0
        sentence = np.repeat(np.arange(len(self.sid)), np.diff(self.tgt_off))
        wide = np.diff(self.src_off)[sentence]
        cuts = np.searchsorted(np.cumsum(wide), np.arange(STEP_PAIRS, wide.sum(), STEP_PAIRS))
        for units in np.split(np.arange(len(self.tgt)), np.unique(cuts)):
            if not len(units):
                continue
            k = wide[units]
            first = np.cumsum(k) - k
            unit = np.repeat(np.arange(len(units)), k)
            at = (self.src_off[sentence[units]] - first)[unit] + np.arange(len(unit))
            keys = self.tgt[units].astype(np.int64)[unit] * self.n_e + self.src[at]
            start = before // 8  # of the bits, one a pair
            shared = np.unpackbits(self.is_shared[start:(before + len(unit) + 7) // 8])[
                before - 8 * start:before - 8 * start + len(unit)].view(bool)
            n = np.count_nonzero(shared)
            yield units, first, unit, at, sentence[units], keys, shared, self.place[placed:placed + n]
            before, placed = before + len(unit), placed + n

    def prior(self, sentence: np.ndarray, at: np.ndarray, n_null: int) -> np.ndarray:
        """Weight of a source word before the table is looked at, without its count."""
        return np.where(self.src[at] == self.null, NULL_PRIOR, WORD_PRIOR / (self.size[sentence] + n_null + 1))

    def shares(self, p: np.ndarray, n_null: int):
        """:meth:`steps` with the part of one target token that goes to the source tokens."""
        for units, first, unit, at, cell, sentence in self.steps():
            copies = np.where(self.src[at] == self.null, n_null, 1) * self.n_src[at]
            weight = p[cell] * copies * self.prior(sentence[unit], at, n_null)
            total = np.add.reduceat(weight, first)[unit]
            with np.errstate(invalid="ignore", divide="ignore"):
                yield units, unit, at, cell, sentence, np.where(total > 0, weight / total, np.nan)

    def first_counts(self) -> np.ndarray:
        counts = np.zeros(len(self.cells))
        for units, _, unit, at, cell, _ in self.steps():
            counts += np.bincount(cell, self.n_src[at] * self.n_tgt[units][unit].astype(float), len(counts))
        return counts

    def grids(self) -> Iterator[tuple]:
        """As :meth:`pairs`, as matrices of target words by places: sentences of one length follow each other.

        Yields the units, their sentences' places as rows of ``src``, of each unit its row, the rows' first
        units, which pairs are shared, where in ``place`` these are, and the sentences.
        """
        wide, units_of = np.diff(self.src_off), np.diff(self.tgt_off)
        runs = np.flatnonzero(np.diff(wide, prepend=-1, append=-1))
        before = placed = 0
        for start, end in zip(runs[:-1], runs[1:]):
            k = int(wide[start])
            sentence = np.repeat(np.arange(start, end), units_of[start:end])
            per_step = max(1, STEP_PAIRS // max(k, 1))
            for a in range(0, len(sentence) if k else 0, per_step):
                some = sentence[a:a + per_step]
                first, n = int(some[0]), len(some) * k
                bit = before // 8  # of the bits, one a pair
                shared = np.unpackbits(self.is_shared[bit:(before + n + 7) // 8])[
                    before - 8 * bit:before - 8 * bit + n].view(bool).reshape(-1, k)
                held = np.count_nonzero(shared)
                unit = int(self.tgt_off[start]) + a
                places = slice(int(self.src_off[first]), int(self.src_off[some[-1] + 1]))
                yield (slice(unit, unit + len(some)), places, some - first,
                       np.flatnonzero(np.diff(some, prepend=-1)), shared, slice(placed, placed + held),
                       slice(first, int(some[-1]) + 1))
                before, placed = before + n, placed + held

    def first_state(self) -> tuple:
        """Sums per source word and counts of shared cells before any round; the two products are empty."""
        sums, held = np.zeros(len(self.src)), np.zeros(len(self.place))
        for units, places, row, starts, shared, found, _ in self.grids():
            n = self.n_src[places].reshape(-1, shared.shape[1])[row] * self.n_tgt[units].astype(float)[:, None]
            held[found] = n[shared]
            self.add_rows(sums, places, row, starts, n)
        counts = added(self.place, held, len(self.shared))
        return added(self.src, sums, self.n_e), counts, scaled(self.n_tgt.astype(float)), scaled(np.ones(self.n_e))

    def add_rows(self, sums: np.ndarray, places: slice, row: np.ndarray, starts: np.ndarray, amounts: np.ndarray) -> None:
        """Add to ``sums``, one a place, what the target words of each sentence give it."""
        sums[places].reshape(-1, amounts.shape[1])[row[starts]] += np.add.reduceat(amounts, starts)

    def factors(self, word_product, n_nulls: list[int]) -> Callable:
        """What places of ``src`` give to the probability of a cell of a single pair: fraction and power of 2.

        A function of the places and their sentences: one number a place of the block would be as many as its pairs.
        """
        per_size, sizes = np.unique(self.size, return_inverse=True)
        word, null = scaled(np.ones(len(per_size))), scaled(np.ones(1))
        times = scaled(np.arange(self.n_src.max(initial=0) + 1.0))  # by count
        power = times
        for n_null in n_nulls:
            word = scaled(word[0] * (WORD_PRIOR / (per_size + n_null + 1)), word[1])
            null = scaled(null[0] * (NULL_PRIOR * n_null), null[1])
            power = scaled(power[0] * times[0], power[1] + times[1])

        def of(places, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            src, n, size = self.src[places], self.n_src[places], sizes[sentence]
            is_null = src == self.null
            return (np.where(is_null, null[0], word[0][size]) * power[0][n] * word_product[0][src],
                    np.where(is_null, null[1], word[1][size]) + power[1][n] + word_product[1][src])

        return of

    def singles(self, unit_product, word_product, n_nulls: list[int]) -> Callable:
        """Probabilities of pairs by unit, place and sentence, right for cells of a single pair."""
        factors = self.factors(word_product, n_nulls)

        def p(units, unit, at, sentence):
            fraction, exponent = factors(at, sentence)
            return np.ldexp(fraction * unit_product[0][units][unit], exponent + unit_product[1][units][unit])

        return p

    def round(self, p_shared: np.ndarray, unit_product, word_product, n_nulls: list[int]) -> tuple:
        """The next state: sums, counts and units' product. The last of ``n_nulls`` is this round's."""
        factors, n_null = self.factors(word_product, n_nulls[:-1]), n_nulls[-1]
        sums, held, scale = np.zeros(len(self.src)), np.zeros(len(self.place)), np.zeros(len(self.tgt))
        with np.errstate(all="ignore"):
            for units, places, row, starts, shared, found, sentences in self.grids():
                def matrix(x: np.ndarray) -> np.ndarray:
                    return x.reshape(-1, shared.shape[1])

                sentence = np.repeat(np.arange(sentences.start, sentences.stop), shared.shape[1])
                fraction, power = factors(places, sentence)
                prior = self.prior(sentence, places, n_null) * self.n_src[places]
                prior *= np.where(self.src[places] == self.null, n_null, 1)
                weight = products(matrix(fraction), matrix(power), row, unit_product[0][units], unit_product[1][units])
                weight[shared] = p_shared[self.place[found]]
                weight *= matrix(prior)[row]
                total = weight.sum(1)
                scale[units] = np.where(total > 0, self.n_tgt[units] / total, 0)
                weight *= scale[units][:, None]
                held[found] = weight[shared]
                self.add_rows(sums, places, row, starts, weight)
        sums, counts = added(self.src, sums, self.n_e), added(self.place, held, len(self.shared))
        return sums, counts, scaled(unit_product[0] * scaled(scale)[0], unit_product[1] + scaled(scale)[1])


@dataclass(frozen=True)
class Blocks:
    """``block, e, parts, f, cut, n_cells, payload`` in the bucketed table ``blocks``; ``e`` in order of its parts."""

    rows: DataFrame
    tables: Tables
    cut: int  # how many target words are in several blocks
    e_type: str
    f_type: str

    def n_cells(self) -> int:
        """Cells of all blocks; those of cut words may be counted more than once."""
        return self.rows.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]


def block_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers, each of which a shuffle and a bucketed table of n parts put in a part of its own.

    Numbers 0 to n - 1 share parts by their hashes, so that one task gets several blocks at once.
    """
    found: dict[int, int] = {}
    start, part = 0, F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    while len(found) < n:
        ids = spark.range(start, start + 16 * n, 1, 1).groupBy(part.alias("part")).agg(F.min("id").alias("id"))
        for row in ids.collect():  # one a part
            found.setdefault(row["part"], row["id"])
        start += 16 * n
    return [found[part] for part in range(n)]


def make_blocks(bags: DataFrame, null, block_pairs: int = BLOCK_PAIRS) -> Blocks:
    """Lay out bags (sid, len, src, tgt), the NULL word among ``src`` if it is to count. One exchange, of messages.

    ``given_sid``, if there, goes with the sentences. The bags are read three times.
    """
    spark = bags.sparkSession
    k, units = (F.size(c).cast("long") for c in ("src", "tgt"))
    total, words = bags.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (k * units, k + units)]).first()
    cores = spark.sparkContext.defaultParallelism
    n = int(max(min(shuffle_partitions(spark), cores), -(-total // block_pairs)))
    n = n if n < cores else -(-n // cores) * cores  # so that no core waits for the last of them
    weights = bags.select(k.alias("k"), F.explode("tgt.w").alias("f")).groupBy("f").agg(F.sum("k").alias("w"))
    hot = weights.filter(F.col("w") * n > total).collect()  # fewer than n words, at most 2n parts
    e_type, f_type = (bags.schema[c].dataType.elementType["w"].dataType for c in ("src", "tgt"))
    cut_words, cuts = pa.array([r["f"] for r in hot], to_arrow_type(f_type)), np.array([-(-r["w"] * n // total) for r in hot], np.int64)
    numbers = block_numbers(spark, n)
    given = F.col("given_sid" if "given_sid" in bags.columns else "sid").alias("given_sid")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(batches, numbers, cut_words, cuts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _built(batches, n)

    # few tasks deal, so that messages are large; a block's words are repeated in each
    dealt = bags.select("sid", given, "len", "src", "tgt", null.alias("null")).coalesce(
        max(cores, -(-words // DEALT_WORDS))).mapInArrow(deal, f"block int, null {e_type.simpleString()}, part binary")
    made = dealt.repartition(n, "block").sortWithinPartitions("block").mapInArrow(
        build, f"block int, e array<{e_type.simpleString()}>, parts array<int>, f array<{f_type.simpleString()}>, cut array<int>, "
               "n_cells long, payload binary")
    tables = Tables(spark, n)
    rows = tables.write(made, "blocks")
    release(spark)
    return Blocks(rows, tables, len(hot), e_type.simpleString(), f_type.simpleString())


def _used(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` numbers occur, and their places among those."""
    there = np.zeros(n, bool)
    there[codes] = True
    return np.flatnonzero(there), narrow((np.cumsum(there) - 1)[codes])


def _dealt(batches: Iterator[pa.RecordBatch], numbers: list[int], cut_words: pa.Array, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sentences as messages to blocks: those with a target word there, with all their source words."""
    n = len(numbers)

    def messages(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        src, tgt = (rows.column(c).combine_chunks() for c in ("src", "tgt"))
        k, units = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (src, tgt))
        src, tgt, src_off = src.flatten(), tgt.flatten(), np.cumsum(k) - k
        (e_no, e), (f_no, f) = (_numbers(x.field("w")) for x in (src, tgt))
        n_src, pos, nf = src.field("n").to_numpy(), src.field("pos").to_numpy(), tgt.field("n").to_numpy()
        sid, size, given = rows.column("sid").to_numpy(), rows.column("len").to_numpy(), rows.column("given_sid").combine_chunks()
        sentence = np.repeat(np.arange(len(rows)), units)
        cut_no = pc.index_in(f, value_set=cut_words).fill_null(-1).to_numpy()
        home = (word_hashes(f) % np.uint64(n)).astype(np.int64)[f_no]
        if len(cuts):
            part = (pd.util.hash_array(sid) >> np.uint64(1)).astype(np.int64)[sentence] % cuts[cut_no[f_no]]
            home = (home + np.where(cut_no[f_no] >= 0, part, 0)) % n
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(n + 1))
        for b, start, end in zip(numbers, starts[:-1], starts[1:]):
            if start == end:
                continue
            mine = order[start:end]
            some, times = np.unique(sentence[mine], return_counts=True)
            places = ranges(src_off[some], k[some])
            e_used, e_at = _used(e_no[places], len(e))
            f_used, f_at = _used(f_no[mine], len(f))
            part = packed((
                sid[some], given.take(pa.array(some)), narrow(size[some]), narrow(k[some]), e.take(pa.array(e_used)), e_at,
                narrow(n_src[places]), narrow(pos[places]), narrow(times), f.take(pa.array(f_used)), f_at, narrow(nf[mine]),
                narrow(cut_no[f_used])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), rows.column("null")[:1].combine_chunks(), pa.array([part], pa.binary())], ["block", "null", "part"])

    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += sum(len(batch.column(c).flatten()) for c in ("src", "tgt"))
        if words >= DEALT_WORDS:
            yield from messages(pa.Table.from_batches(held))
            held, words = [], 0
    if sum(x.num_rows for x in held):
        yield from messages(pa.Table.from_batches(held))


def _built(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The messages of each block, which follow each other, as the block."""
    block, held = None, []
    for batch in batches:
        for b, null, part in zip(*[batch.column(c) for c in ("block", "null", "part")]):
            if held and b != block:
                yield _build(block, null_word, held, n)
                held = []
            block, null_word = b, null
            held.append(unpacked(part.as_buffer()))
    if held:
        yield _build(block, null_word, held, n)


def _numbers(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = words.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (from 0), of each key its place among them, and how often they occur.

    Keys are sorted with their positions in the low bits, which is several times faster than sorting positions.
    """
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)) >> (63 - bits):
        return np.unique(keys, return_inverse=True, return_counts=True)
    found = np.sort(keys << bits | np.arange(len(keys)))
    order = found & ((1 << bits) - 1)
    found >>= bits
    first = np.flatnonzero(np.diff(found, prepend=-1))
    times = np.diff(first, append=len(found))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), times)
    return found[first], place, times


def _merged(words: tuple[pa.Array, ...], numbers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """Numbers by the distinct words of all messages, these words, and what number each message's words have."""
    codes, known = _numbers(pa.concat_arrays(words))
    codes = np.split(codes.astype(np.int32), np.cumsum([len(x) for x in words])[:-1])
    return np.concatenate([code[x] for code, x in zip(codes, numbers)]), known, codes


def _build(block: pa.Scalar, null: pa.Scalar, messages: list[tuple], n: int) -> pa.RecordBatch:
    sid, given, size, k, e_words, e_at, n_src, pos, times, f_words, f_at, nf, cut_no = zip(*messages)
    messages.clear()
    words, e, _ = _merged(e_words, e_at)
    units, f, f_codes = _merged(f_words, f_at)
    cut_of = np.full(len(f), -1, np.int32)
    for codes, x in zip(f_codes, cut_no):
        cut_of[codes] = x
    part = (word_hashes(e) % np.uint64(n)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")  # words by their parts
    place_of = np.empty(len(e), np.int32)
    place_of[by_part] = np.arange(len(e), dtype=np.int32)
    e, words, part = e.take(pa.array(by_part)), place_of[words], part[by_part]
    null_no = e.index(pa.scalar(null.as_py(), e.type)).as_py()
    # by length, for Block.grids, then so that sums do not depend on the order of arrival
    sid, size, k, times, n_src, pos, nf = (np.concatenate(x) for x in (sid, size, k, times, n_src, pos, nf))
    k, times = k.astype(np.int64), times.astype(np.int64)
    order = np.lexsort((sid, k))
    at, unit_at = ranges((np.cumsum(k) - k)[order], k[order]), ranges((np.cumsum(times) - times)[order], times[order])
    words, n_src, pos, units, nf = words[at], n_src[at], pos[at], units[unit_at], nf[unit_at]
    del at, unit_at, e_at, f_at
    k, times = k[order], times[order]
    src_off, tgt_off = (np.concatenate([[0], np.cumsum(x)]) for x in (k, times))
    n_e, sentence = len(e), np.repeat(np.arange(len(sid)), times)
    wide, start = k[sentence], src_off[:-1][sentence]
    first = np.cumsum(wide) - wide
    shared, place = np.zeros(int(wide.sum()), bool), np.empty(int(wide.sum()), np.int32)
    held, n_cells, n_shared, cut_all, cut_shared = [np.empty(0, np.int64)], 0, 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # by target word, some pairs at a time: their cells are no others'
    by_f = np.argsort(units, kind="stable")
    ends = np.flatnonzero(np.diff(units[by_f], append=len(f)))
    weight = np.cumsum(wide[by_f])
    step = ends[np.searchsorted(weight[ends], np.arange(STEP_PAIRS, weight[-1] if len(weight) else 0, STEP_PAIRS))] + 1
    large = np.flatnonzero(np.diff(weight[ends], prepend=0) > 2 * STEP_PAIRS)
    starts = np.concatenate([[0], ends + 1])
    for some in np.split(by_f, np.unique(np.concatenate([step, starts[large], starts[large + 1]]))):
        # of one very frequent word not all at once: its source words are counted first
        runs = np.split(some, np.searchsorted(np.cumsum(wide[some]), np.arange(2 * STEP_PAIRS, wide[some].sum(), 2 * STEP_PAIRS)))
        one = len(runs) > 1 and units[some[0]] == units[some[-1]]
        runs = [x for x in runs if len(x)] if one else [some]
        if one:
            found = np.zeros(n_e, np.int64)
            for x in runs:
                found += np.bincount(words[ranges(start[x], wide[x])], minlength=n_e)
            mine = np.flatnonzero(found)
            cells, often, cell_of = mine + int(units[some[0]]) * n_e, found[mine], np.cumsum(found > 0) - 1
        for x in runs:
            of = words[ranges(start[x], wide[x])]
            if one:
                cell = cell_of[of]
            else:
                cells, cell, often = distinct(np.repeat(units[x].astype(np.int64) * n_e, wide[x]) + of)
            cut = cut_of[cells // n_e] >= 0 if len(cells) else np.empty(0, bool)
            many = (often > 1) | cut
            pairs, is_shared = ranges(first[x], wide[x]), many[cell]
            shared[pairs] = is_shared
            place[pairs[is_shared]] = n_shared + (np.cumsum(many) - 1)[cell[is_shared]]
        if not len(some):
            continue
        held.append(cells[many])
        cut_all.append(n_cells + np.flatnonzero(cut))
        cut_shared.append(n_shared + np.flatnonzero(cut[many]))
        n_cells, n_shared = n_cells + len(cells), n_shared + np.count_nonzero(many)
    cells, cut = np.concatenate(held), np.concatenate(cut_shared)
    cut = cut[np.argsort(cells[cut] % max(n_e, 1), kind="stable")]  # by source word, hence by parts
    payload = packed((
        sid[order], pa.concat_arrays(given).take(pa.array(order)), size[order].astype(np.int32), src_off, words, n_src, pos, tgt_off,
        units, nf, n_e, null_no, np.packbits(shared), place[shared], cells, cut, narrow(cut_of)))

    def lists(values, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    return pa.RecordBatch.from_arrays([
        pa.array([block.as_py()], pa.int32()), lists(e, e.type), lists(np.searchsorted(part, np.arange(n + 1)), pa.int32()),
        lists(f, f.type), lists(np.concatenate(cut_all), pa.int32()), pa.array([n_cells], pa.int64()), pa.array([payload], pa.binary())],
        ["block", "e", "parts", "f", "cut", "n_cells", "payload"])


def over_blocks(rows: DataFrame, work: Callable[[Block, dict], pa.RecordBatch | Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``work`` on each block of ``rows``, with the row's other columns by name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                made = work(Block(row["payload"].as_buffer()), row)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made

    return rows.mapInArrow(run, schema)


def cell_counts(blocks: Blocks) -> DataFrame:
    """How often the cells occur: ``e, f, n``. Only the cells of cut words are added up by an exchange."""
    def counts(block: Block, row: dict, of_cut: bool) -> Iterator[pa.RecordBatch]:
        e, f = row["e"].values, row["f"].values

        def cells(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                e.take(pa.array(keys % block.n_e)), f.take(pa.array(keys // block.n_e)),
                pa.array(n.astype(np.int64))], ["e", "f", "n"])

        shared_n = np.zeros(len(block.shared))
        for units, _, unit, at, _, keys, shared, place in block.pairs():
            n = block.n_src[at] * block.n_tgt[units].astype(float)[unit]
            shared_n += np.bincount(place, n[shared], len(shared_n))
            if not of_cut:
                yield cells(keys[~shared], n[~shared])
        mine = np.full(len(shared_n), not of_cut)
        mine[block.cut] = of_cut
        for a in range(0, len(mine), STEP_PAIRS):
            some = mine[a:a + STEP_PAIRS]
            yield cells(block.shared[a:a + STEP_PAIRS][some], shared_n[a:a + STEP_PAIRS][some])

    schema = f"e {blocks.e_type}, f {blocks.f_type}, n long"
    whole = over_blocks(blocks.rows, lambda b, row: counts(b, row, False), schema)
    if not blocks.cut:
        return whole
    parts = over_blocks(blocks.rows.filter(F.size("cut") > 0), lambda b, row: counts(b, row, True), schema)
    return whole.unionByName(parts.groupBy("e", "f").agg(F.sum("n").alias("n")))


# --- routing --------------------------------------------------------------------

def to_blocks(values: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows (block, pos, …) as one row a block with the array ``given`` in order of ``pos``."""
    return values.repartition(n, "block").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("given"))


def word_homes(blocks: Blocks) -> DataFrame:
    """Each part ``e`` of the source words: the places of every block's words in it, by block.

    With them go the places of the block's cells of cut words among all such cells of the part, and which it reports.
    """
    n, n_cut = blocks.tables.n, blocks.cut

    def needs(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        words, parts = row["e"].values, row["parts"].values.to_numpy()
        cut = block.shared[block.cut]
        ends = np.searchsorted(cut % max(block.n_e, 1), parts)
        for part in np.flatnonzero(np.diff(parts)):
            cells = cut[ends[part]:ends[part + 1]]
            need = packed((words.slice(parts[part], parts[part + 1] - parts[part]).take(pa.array(np.arange(parts[part + 1] - parts[part]))),
                           narrow(cells % block.n_e - parts[part]), block.cut_no[cells // block.n_e]))
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([row["block"].as_py()], pa.int32()), pa.array([need], pa.binary())],
                ["e", "block", "need"])

    def index(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block").combine_chunks()
        words, of, cut_no = zip(*[unpacked(x.as_buffer()) for x in rows.column("need").combine_chunks()])
        places, known, codes = _merged(words, tuple(np.arange(len(x)) for x in words))
        # a cell is known by its word's place in the part and the number of its cut word
        keys = np.concatenate([code[x].astype(np.int64) * max(n_cut, 1) + c for code, x, c in zip(codes, of, cut_no)])
        cells, cell, _ = distinct(keys)
        reports = np.zeros(len(keys), np.int8)
        reports[np.unique(keys, return_index=True)[1]] = 1  # the first block of those that have it
        cuts = np.cumsum([len(x) for x in of])[:-1]

        def split(x: np.ndarray) -> list[bytes]:
            return [y.tobytes() for y in np.split(x, cuts)]

        return pa.table({
            "e": rows.column("e")[:1], "n_words": pa.array([len(known)], pa.int64()), "n_cells": pa.array([len(cells)], pa.int64()),
            "blocks": pa.array([rows.column("block").to_pylist()], pa.list_(pa.int32())),
            "places": pa.array([[x.tobytes() for x in codes]], pa.list_(pa.binary())),
            "cells": pa.array([split(cell.astype(np.int32))], pa.list_(pa.binary())),
            "reports": pa.array([split(reports)], pa.list_(pa.binary()))})

    made = over_blocks(blocks.rows, needs, "e int, block int, need binary").repartition(n, "e").groupBy("e").applyInArrow(
        index, "e int, n_words long, n_cells long, blocks array<int>, places array<binary>, cells array<binary>, reports array<binary>")
    return blocks.tables.write_by(made, "homes", "e")


def totals(state: DataFrame, homes: DataFrame, n: int) -> DataFrame:
    """For each block the sum over all blocks of each source word of its need list, by parts.

    A word has at most one number a block, however often it occurs. The sums of the part's cells of cut
    words follow, then which of them the block reports.
    """
    sent = state.select("block", F.posexplode("sums").alias("e", "s")).filter(F.length("s") > 0)
    sent = sent.repartition(n, "e").groupBy("e").agg(F.collect_list(F.struct("block", "s")).alias("sent"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums = {x["block"]: np.frombuffer(x["s"]) for x in row["sent"]}
                total, whole = np.zeros(row["n_words"]), np.zeros(row["n_cells"])
                places, cells = ([np.frombuffer(x, np.int32) for x in row[c]] for c in ("places", "cells"))
                for block, place, cell in zip(row["blocks"], places, cells):
                    total[place] += sums[block][:len(place)]
                    whole[cell] += sums[block][len(place):]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["blocks"], pa.int32()), pa.array([row["e"]] * len(places), pa.int32()),
                    pa.array([total[place].tobytes() + whole[cell].tobytes() + x for place, cell, x in zip(places, cells, row["reports"])],
                             pa.binary())], ["block", "pos", "total"])

    back = homes.join(sent.hint("shuffle_hash"), "e").mapInArrow(add, "block int, pos int, total binary")
    return to_blocks(back, n, "total").select("block", F.transform("given", lambda x: x["total"]).alias("totals"))


def route_table(blocks: Blocks, table: DataFrame, strategy: str, row_bytes: int,
                broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Blocks with ``given``: places and values of their cells in the table ``e, f, p``.

    The table's cells whose target word a block has are dealt to it as arrays, some
    :data:`ROUTED_CELLS` at a time, and looked up there one chunk after the other. The
    words of the blocks are broadcast if they fit, whatever the strategy, so that the
    table is read in place; beyond that it is dealt by target word before.
    """
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    targets = blocks.rows.select("block", F.posexplode("f").alias("f_no", "f"))
    sources = blocks.rows.select(F.explode("e").alias("e")).distinct()
    n_targets = blocks.rows.agg(F.coalesce(F.sum(F.size("f")), F.lit(0))).first()[0]
    cells = table.select("e", "f", F.coalesce("p", F.lit(float("-inf"))).alias("p")).filter(F.col("e").isNotNull())
    if fits_broadcast(sources.count(), row_bytes, broadcast_limit):
        cells = cells.join(F.broadcast(sources), "e", "left_semi")
    fits = fits_broadcast(n_targets, row_bytes, broadcast_limit)
    cells = cells.join(F.broadcast(targets) if fits else targets.hint("shuffle_hash"), "f")
    chunks = cells.select("block", "f_no", F.col("e").cast(blocks.e_type).alias("e"), "p").mapInArrow(
        _chunks, f"block int, words array<{blocks.e_type}>, cells binary")
    # only the chunks move: the blocks lie by their numbers already
    chunks = chunks.repartition(blocks.tables.n, "block").groupBy("block")
    return blocks.rows.select("block", "e", "f", "payload").groupBy("block").cogroup(chunks).applyInArrow(
        _looked_up, f"block int, e array<{blocks.e_type}>, f array<{blocks.f_type}>, payload binary, given binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (block, f_no, e, p) as one row a block and chunk: distinct words, and arrays of their numbers."""
    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows.take(pa.array(order)).combine_chunks()
        ends = [*np.flatnonzero(np.diff(block)) + 1, len(block)]
        for start, end in zip([0, *ends], ends):
            some = rows.slice(start, end - start)
            number, words = _numbers(some.column("e").combine_chunks())
            f_no = some.column("f_no").to_numpy()
            # in order, numbers compress to a fraction
            by_cell = np.lexsort((number, f_no))
            cells = packed((narrow(number[by_cell]), narrow(f_no[by_cell]), some.column("p").to_numpy()[by_cell]))
            yield pa.RecordBatch.from_arrays([
                pa.array([block[start]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([cells], pa.binary())], ["block", "words", "cells"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= ROUTED_CELLS:
            yield from chunk(held)
            held = []
    if any(x.num_rows for x in held):
        yield from chunk(held)


class Lookup:
    """What a table gives to the cells of one block, chunk by chunk; of a cell's rows the largest counts."""

    def __init__(self, row: pa.RecordBatch):
        self.row, self.block = row, Block(row.column("payload")[0].as_buffer())
        self.words = row.column("e")[0].values
        self.p = np.full(len(self.block.cells), -np.inf)
        self.known = np.zeros(len(self.p), bool)
        self.waiting: list[tuple] = []

    def add(self, words: pa.Array, cells: pa.Buffer) -> None:
        self.waiting.append((words, *unpacked(cells)))
        if sum(len(x[-1]) for x in self.waiting) >= ROUTED_CELLS:
            self.look()

    def look(self) -> None:
        if not self.waiting:
            return
        words, number, f_no, p = zip(*self.waiting)
        self.waiting = []
        starts = np.cumsum([0, *map(len, words)])
        number = np.concatenate([x.astype(np.int64) + start for x, start in zip(number, starts)])
        place = pc.index_in(pa.concat_arrays(words), value_set=self.words)
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[number]
        mine = place >= 0
        keys = (np.concatenate(f_no).astype(np.int64) * self.block.n_e + place)[mine]
        order = np.argsort(keys)
        keys, p = keys[order], np.concatenate(p)[mine][order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        if not len(first):
            return
        keys, p = keys[first], np.maximum.reduceat(p, first)
        at = np.minimum(np.searchsorted(self.block.cells, keys), len(self.p) - 1)
        there = self.block.cells[at] == keys
        at = at[there]
        self.p[at] = np.maximum(self.p[at], p[there])
        self.known[at] = True

    def found(self) -> pa.RecordBatch:
        self.look()
        places, p = np.flatnonzero(self.known).astype(np.int32), self.p[self.known]
        given = packed((places, np.where(p == -np.inf, np.nan, p))) if len(places) else None
        names = ["block", "e", "f", "payload"]
        return pa.RecordBatch.from_arrays(
            [*[self.row.column(c) for c in names], pa.array([given], pa.binary())], [*names, "given"])


def _looked_up(block: pa.Table, chunks: pa.Table) -> pa.Table:
    """A block with ``given``, what its chunks hold for it."""
    lookup = Lookup(block.combine_chunks().to_batches()[0])
    for words, cells in zip(chunks.column("words"), chunks.column("cells")):
        lookup.add(words.values, cells.as_buffer())
    return pa.Table.from_batches([lookup.found()])


def given_values(block: Block, row: dict) -> np.ndarray:
    """The routed table at the block's cells; an absent cell reads as 0."""
    p = np.zeros(len(block.cells))
    if row["given"].is_valid:
        places, values = unpacked(row["given"].as_py())
        p[places] = values
    return np.nan_to_num(p)


def known_cells(block: Block, row: dict) -> np.ndarray:
    """Which of the block's cells the routed table has."""
    known = np.zeros(len(block.cells), bool)
    if row["given"].is_valid:
        known[unpacked(row["given"].as_py())[0]] = True
    return known


# --- training -------------------------------------------------------------------

def train_blocks(blocks: Blocks, rounds: int, null_growth: bool) -> DataFrame:
    """The table ``e, f, p`` after ``rounds``, made from the last state whenever it is read."""
    tables = blocks.tables
    numbers = ["counts", "unit", "unit_power", "word", "word_power"]
    lists = "block int, sums array<binary>, " + ", ".join(f"{c} binary" for c in numbers)

    def nulls(k: int) -> list[int]:
        """NULL words of the rounds up to ``k``."""
        return [j + 1 if null_growth else 1 for j in range(1, k + 1)]

    def by_parts(block: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of the words end, and those of the cells of cut words."""
        parts = row["parts"].values.to_numpy()
        return parts, np.searchsorted(block.shared[block.cut] % max(block.n_e, 1), parts)

    def state(block: Block, row: dict, sums, counts, unit, word) -> pa.RecordBatch:
        parts, cells = (np.split(x, ends[1:-1]) for x, ends in zip((sums, counts[block.cut]), by_parts(block, row)))
        out = [row["block"].as_py(), [x.tobytes() + y.tobytes() for x, y in zip(parts, cells)], *[x.tobytes() for x in (counts, *unit, *word)]]
        types = [pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * len(numbers)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types)],
                                          [c.split(" ")[0] for c in lists.split(", ")])

    def read(block: Block, row: dict) -> tuple:
        """Probabilities of the shared cells, NaN where a word's total is 0; both products; the totals; cut cells it reports."""
        counts, unit, unit_power, word, word_power = (
            np.frombuffer(row[c].as_buffer(), np.int32 if c.endswith("power") else np.float64) for c in numbers)
        parts, cells = by_parts(block, row)
        total, whole, own = np.empty(block.n_e), np.empty(len(block.cut)), np.empty(len(block.cut), bool)
        used = np.flatnonzero(np.diff(parts))
        for part, sent in zip(used, row["totals"].values):
            sent, k, c = memoryview(sent.as_buffer()), int(parts[part + 1] - parts[part]), slice(cells[part], cells[part + 1])
            m = c.stop - c.start
            total[parts[part]:parts[part + 1]] = np.frombuffer(sent, np.float64, k)
            whole[c], own[c] = np.frombuffer(sent, np.float64, m, 8 * k), np.frombuffer(sent, bool, m, 8 * (k + m))
        if len(whole):
            counts = counts.copy()
            counts[block.cut] = whole
        with np.errstate(invalid="ignore", divide="ignore"):
            of = total[block.shared % block.n_e]
            p = np.where(of > 0, counts / of, np.nan)
            share, power = scaled(np.where(total > 0, 1 / scaled(total)[0], 0), word_power - scaled(total)[1])
            word = scaled(word * share, power)
        return p, (unit, unit_power), word, total, own

    # a round works on numbers; words are read for the table
    numbered = blocks.rows.select("block", "parts", "payload")

    def joined(last: DataFrame, rows: DataFrame) -> DataFrame:
        """Blocks with their state and what is routed to them; nothing else moves."""
        return rows.join(last.select("block", *numbers).hint("shuffle_hash"), "block").join(
            totals(last, homes, tables.n).hint("shuffle_hash"), "block")

    def step(block: Block, row: dict, k: int) -> pa.RecordBatch:
        p, unit, word, *_ = read(block, row)
        sums, counts, unit = block.round(np.nan_to_num(p), unit, word, nulls(k))
        return state(block, row, sums, counts, unit, word)

    def result(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        e, f = row["e"].values, row["f"].values

        def cells(keys: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                e.take(pa.array(keys % block.n_e)), f.take(pa.array(keys // block.n_e)),
                pa.array(p, from_pandas=True)], ["e", "f", "p"])

        p, unit, word, total, own = read(block, row)
        mine = np.ones(len(p), bool)
        mine[block.cut] = own
        for a in range(0, len(p), STEP_PAIRS):
            some = mine[a:a + STEP_PAIRS]
            yield cells(block.shared[a:a + STEP_PAIRS][some], p[a:a + STEP_PAIRS][some])
        single = block.singles(unit, word, nulls(rounds))
        with np.errstate(all="ignore"):
            for units, _, of, at, sentence, keys, shared, _ in block.pairs():
                of, at = of[~shared], at[~shared]
                yield cells(keys[~shared], np.where(total[block.src[at]] > 0, 1, np.nan) * single(units, of, at, sentence[of]))

    try:
        homes = word_homes(blocks)
        last = tables.write(over_blocks(numbered, lambda b, row: state(b, row, *b.first_state()), lists), "round0")
        for k in range(1, rounds + 1):
            last = tables.write(over_blocks(joined(last, numbered), lambda b, row, k=k: step(b, row, k), lists), f"round{k}")
            tables.drop(f"round{k - 1}")
            release(tables.spark)
        return over_blocks(joined(last, blocks.rows), result, f"e {blocks.e_type}, f {blocks.f_type}, p double")
    except BaseException:
        tables.drop()
        raise
    finally:
        tables.forget()
