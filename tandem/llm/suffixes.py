"""Repeated passages by a distributed merge sort of suffixes that keeps common prefixes.

A byte goes if it is covered by a string of ``window`` bytes that also starts in a
document of smaller id. Suffixes are compared up to ``window`` bytes, as follows.

1. *Blocks.* Texts are gathered into compressed blocks of about ``BLOCK`` bytes.
2. *Anchors.* Of the ``ANCHOR``-byte strings in each window the one of least hash is an
   anchor, so equal windows have equal anchors in equal places and only suffixes that
   start at anchors, about one in 15, need sorting. The bytes before an anchor that a
   window around it can reach follow its suffix, backwards: its context.
3. *Duplicate detection.* Hashes of anchors, sorted and packed, are exchanged by
   range; a block learns which of its anchors some other block has too. A suffix whose
   anchor is in one document only is not exchanged at all.
4. *Runs.* A block sorts the contexts that are left, keeps equal ones once with the
   least and greatest document id, and sends each range of the order to its task,
   front-coded: the length shared with the context before, and the bytes after it.
5. *Merge.* A task merges its runs with a loser tree that holds the common prefix of
   every loser with the last winner. Unequal lengths decide without looking at bytes,
   equal ones compare from there on, so known prefixes are never compared again. The
   lengths that come out say, for every window around an anchor, who has it first.
6. *Answer.* A block gets these least ids back, marks its bytes and cuts its texts.

No step gathers all copies of a passage: a block sends each context once, however
many of its documents have it. Hash collisions only let a suffix into the exchange.

Defined cases: null is the empty text; a null id counts as larger than all others and
as equal to other nulls; rows of one id do not remove from each other; a text shorter
than the window is kept whole; matches do not cross documents; other columns are not
read; an empty table gives no rows. Bytes are those of UTF-8, so a cut may split a
character, and ``kept`` is binary.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, id_and_text, stored
from tandem.session import shuffle_partitions

WINDOW = 50
ANCHOR = 20
BLOCK = 4 << 20
#: Text that one task of the exchange answers for.
PART = 16 << 20
#: Strings taken from each block for the borders of the ranges, and most of all.
SAMPLES, MOST_SAMPLES = 64, 1 << 16
LARGEST = (1 << 63) - 1
DOCS, ANSWER, RUN, PLACES, FOUND = range(5)
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, 5))


def unpack(packed: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(packed))


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes by significance: sorted or small numbers get long runs that pack well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T)


def from_planes(held: np.ndarray, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(held.T).reshape(-1).view(">u8").astype(np.uint64).view(dtype)


# --- anchors -------------------------------------------------------------------

def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    rest = width - size
    return best(x[:len(x) - rest], x[rest:]) if rest else x


_POWERS: list[np.ndarray] = []


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` neighbours of at most _CHUNK + 64 bytes."""
    if not _POWERS:
        n = _CHUNK + 4096
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    up, down = _POWERS
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:len(raw)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * up[:len(sums) - size]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))


def anchors(raw: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending, and hashes of the anchors of texts that end at ``ends``."""
    width, n = window - anchor + 1, len(raw)
    limit = np.repeat(ends, np.diff(ends, prepend=0))
    places, hashes = [], []
    for a in range(0, n, _CHUNK):
        part = raw[a:a + _CHUNK + window - 1]
        if len(part) < window:
            break
        h = gram_hashes(part, anchor)
        least = sliding(h, width, np.minimum)
        starts = np.arange(a, a + len(least))
        least = np.where(starts + window <= limit[starts], least, np.uint64(0))
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1:width - 1 + len(least)] = least
        found = np.flatnonzero(h == sliding(around, width, np.maximum))
        places.append(found + a)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


# --- blocks --------------------------------------------------------------------

def gather(docs: DataFrame, window: int, block: int) -> DataFrame:
    """``block, bytes, sample, payload``: ids, null flags, ends and bytes of some texts."""
    def one(ids: list, texts: list[bytes], number: int) -> pa.RecordBatch:
        raw = b"".join(texts)
        at = np.linspace(0, max(len(raw) - window, 0), SAMPLES).astype(int)
        payload = pack(np.array([LARGEST if i is None else i for i in ids], np.int64),
                       np.array([i is None for i in ids]),
                       np.cumsum([len(t) for t in texts], dtype=np.int64), raw)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([len(raw)], pa.int64()),
            pa.array([[raw[i:i + ANCHOR] for i in at]], pa.list_(pa.binary())),
            pa.array([payload], pa.binary())], ["block", "bytes", "sample", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(ID), batch.column(TEXT)):
                ids.append(i.as_py())
                texts.append(t.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= block:
                    yield one(ids, texts, number)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield one(ids, texts, number)

    return id_and_text(docs).mapInArrow(run, "block long, bytes long, sample array<binary>, payload binary")


# --- duplicate detection -------------------------------------------------------

def short(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * width)


def send_hashes(blocks: DataFrame, parts: int, width: int, window: int, anchor: int) -> DataFrame:
    """``part, block, payload``: distinct hashes of a block in one range, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                _, _, ends, raw = unpack(payload.as_py())
                known = np.unique(short(anchors(np.frombuffer(raw, np.uint8), ends, window, anchor)[1], width))
                part = (known >> np.uint64(8 * width - 32)) * np.uint64(parts) >> np.uint64(32)
                used, cuts = np.unique(part, return_index=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int64)), pa.array([block] * len(used), pa.int64()),
                    pa.array([pack(planes(x)) for x in np.split(known, cuts[1:])] if len(used) else [], pa.binary())],
                    ["part", "block", "payload"])

    return blocks.select("block", "payload").mapInArrow(run, "part long, block long, payload binary")


def repeats(sent: pa.Table) -> pa.Table:
    """Per block the hashes of one range that another block has too."""
    blocks = sent.column("block").to_pylist()
    each = [from_planes(unpack(p.as_py())[0], np.uint64) for p in sent.column("payload")]
    flat = np.concatenate(each)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out = [(b, x[m]) for b, x, m in zip(blocks, each, np.split(twice, np.cumsum([len(x) for x in each])[:-1])) if m.any()]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                     "payload": pa.array([pack(planes(x)) for _, x in out], pa.binary())})


# --- runs ----------------------------------------------------------------------

def contexts(raw: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             window: int, anchor: int) -> np.ndarray:
    """A row each: suffix, bytes before it backwards, how many there are of either."""
    left = window - anchor
    padded = np.concatenate([np.zeros(left, np.uint8), raw, np.zeros(window, np.uint8)])
    around = sliding_window_view(padded, left + window)[places]
    ahead, behind = np.minimum(ends - places, window), np.minimum(places - starts, left)
    rows = np.empty((len(places), left + window + 2), np.uint8)
    rows[:, :window] = np.where(np.arange(window) < ahead[:, None], around[:, left:], 0)
    rows[:, window:-2] = np.where(np.arange(left) < behind[:, None], around[:, :left][:, ::-1], 0)
    rows[:, -2], rows[:, -1] = ahead, behind
    return rows


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        unlike = rows[a:a + (1 << 16)] != rows[a - 1:a - 1 + len(rows[a:a + (1 << 16)])]
        out[a:a + len(unlike)] = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
    return out


def as_strings(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1]}").reshape(-1)


def front_code(rows: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shared = shared.copy()
    shared[:1] = 0
    return shared.astype(np.uint8), rows[np.arange(rows.shape[1]) >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    shared = shared.astype(np.int64)
    begins = np.cumsum(width - shared) - (width - shared) - shared
    rows, at = np.empty((len(shared), width), np.uint8), np.arange(len(shared))
    for c in range(width):  # a shared byte is that of the last row that wrote it
        rows[:, c] = rest[begins[np.maximum.accumulate(np.where(shared <= c, at, 0))] + c]
    return rows


def make_runs(table: pa.Table, borders: np.ndarray, width: int, window: int, anchor: int) -> pa.Table:
    """The runs of one block, one a range, and where their contexts occur."""
    ids = hashes = None
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
        if kind == DOCS:
            ids, _, ends, raw = unpack(payload.as_py())
    answers = [from_planes(unpack(p.as_py())[0], np.uint64)
               for k, p in zip(table.column("kind").to_pylist(), table.column("payload")) if k == ANSWER]
    raw = np.frombuffer(raw, np.uint8)
    places, hashes = anchors(raw, ends, window, anchor)
    keys = short(hashes, width)
    doc = np.searchsorted(ends, places, "right")
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] + np.uint64(1)) != 0)
    sizes = np.diff(np.append(first, len(keys)))
    inside = np.zeros(len(keys), bool)  # anchors that two documents of this block have
    if len(first):
        spans = doc[order[first]] != doc[order[first + sizes - 1]]
        inside[order] = np.repeat(spans, sizes)
    if answers:
        known = np.sort(np.concatenate(answers))
        inside |= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    begin, end = np.concatenate([[0], ends])[doc], ends[doc]
    chosen = np.flatnonzero(inside)
    places, doc, begin, end = places[chosen], doc[chosen], begin[chosen], end[chosen]
    rows = contexts(raw, places, begin, end, window, anchor)
    order = np.argsort(as_strings(rows), kind="stable")
    rows, places, owner = rows[order], places[order], ids[doc[order]]
    shared = shared_prefixes(rows)
    first = np.flatnonzero(shared < rows.shape[1]) if len(rows) else np.empty(0, np.int64)
    least = np.minimum.reduceat(owner, first) if len(first) else owner
    most = np.maximum.reduceat(owner, first) if len(first) else owner
    rows, shared = rows[first], shared[first]
    cuts = np.concatenate([[0], np.searchsorted(as_strings(rows), borders), [len(rows)]])
    block, out = table.column("block")[0].as_py(), []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            out.append((part, RUN, pack(int(a), *front_code(rows[a:b], shared[a:b]),
                                        planes(least[a:b]), planes(most[a:b] - least[a:b]))))
    out.append((-1 - block % (len(borders) + 1), PLACES, pack(first.astype(np.int32), places.astype(np.int32))))
    return pa.table({"part": pa.array([p for p, _, _ in out], pa.int64()),
                     "block": pa.array([block] * len(out), pa.int64()),
                     "kind": pa.array([k for _, k, _ in out], pa.int32()),
                     "payload": pa.array([x for _, _, x in out], pa.binary())})


# --- merge ---------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of unlike ``a`` and ``b``, known to be ``start`` at least."""
    while True:
        x, y = a[start:start + 8], b[start:start + 8]
        if x != y:
            n = min(len(x), len(y))
            unlike = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + n - (unlike.bit_length() + 7) // 8
        start += 8


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """The runs in order: whose turn it is, and the prefix shared with the one before.

    A loser tree. ``prefix[r]`` is what the head of run r has in common with the last
    winner that met it; of two heads the one with more in common with that winner is
    the smaller. Only at equal lengths are bytes looked at, from that length on, and
    the loser then keeps what it has in common with its new winner.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [r[0] if r else None for r in runs] + [None] * (leaves - len(runs))
    prefix = [0 if h is not None else -1 for h in heads]
    at, losers = [0] * leaves, [0] * leaves
    lasts = [len(r) for r in runs] + [0] * (leaves - len(runs))

    def play(winner: int, node: int) -> int:
        """The winner of ``winner`` and the loser that waits at the node."""
        other = losers[node]
        mine, theirs = prefix[winner], prefix[other]
        if mine > theirs:
            return winner
        if mine == theirs:
            if mine < 0:
                return winner
            a, b = heads[winner], heads[other]
            if a == b:
                prefix[other] = len(a)
                return winner
            both = common_prefix(a, b, mine)
            if a < b:
                prefix[other] = both
                return winner
            prefix[winner] = both
        losers[node] = winner
        return other

    won = list(range(leaves)) * 2
    for node in range(leaves - 1, 0, -1):  # leaves are won[leaves:]
        left, right = (won[c] if c < leaves else c - leaves for c in (2 * node, 2 * node + 1))
        losers[node] = right
        won[node] = play(left, node)
    winner = won[1] if leaves > 1 else 0
    turns, lengths = [], []
    while prefix[winner] >= 0:
        turns.append(winner)
        lengths.append(prefix[winner])
        at[winner] = n = at[winner] + 1
        if n < lasts[winner]:
            heads[winner], prefix[winner] = runs[winner][n], shared[winner][n]
        else:
            heads[winner], prefix[winner] = None, -1
        node = (winner + leaves) // 2
        while node:
            other = losers[node]  # as play(), whose commonest case needs no call
            if prefix[winner] <= prefix[other]:
                winner = play(winner, node)
            node //= 2
    return turns, lengths


def classes(shared: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the rows, in their order, that agree in the first ``length`` bytes."""
    return np.cumsum(shared < length)


def first_owners(rows: np.ndarray, shared: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each window around a context, by bytes before the anchor, the least id that has it.

    Contexts share a window if they agree in the suffix up to its end and backwards
    up to its start. ``rows`` are sorted, so their common prefixes give the classes.
    """
    left, n = rows.shape[1] - window - 2, len(rows)
    ahead, behind = rows[:, -2].astype(int), rows[:, -1].astype(int)
    order = np.argsort(as_strings(rows[:, window:-2]), kind="stable")
    before = shared_prefixes(rows[order][:, window:-2])
    out = np.full((left + 1, n), LARGEST, np.int64)
    for back in range(left + 1):
        real = np.flatnonzero((ahead >= window - back) & (behind >= back))
        if not len(real):
            continue
        key = classes(shared, window - back).astype(np.int64) * (n + 1)
        key[order] += classes(before, back) if back else 0
        key = key[real]
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[by], prepend=-1))
        found = np.minimum.reduceat(least[real][by], starts)
        out[back, real[by]] = np.repeat(found, np.diff(np.append(starts, len(by))))
    return out


def merge_runs(sent: pa.Table, window: int, anchor: int) -> pa.Table:
    """Answers to all blocks that sent a run of this range."""
    if sent.column("kind")[0].as_py() == PLACES:
        return sent.select(["block", "kind", "payload"])
    blocks = sent.column("block").to_pylist()
    width, held = 2 * window - anchor + 2, [unpack(p.as_py()) for p in sent.column("payload")]
    tables = [front_decode(s, rest, width) for _, s, rest, _, _ in held]
    runs = []
    for rows in tables:
        flat = rows.tobytes()
        runs.append([flat[i:i + width] for i in range(0, len(flat), width)])
    turns, lengths = merge(runs, [h[1].tolist() for h in held])
    del runs
    turns, lengths = np.array(turns), np.array(lengths)
    # the n-th turn of a run is its n-th row
    order = np.empty(len(turns), np.int64)
    order[np.argsort(turns, kind="stable")] = np.arange(len(turns))
    rows = np.concatenate(tables)[order]
    least = np.concatenate([from_planes(h[3]) for h in held])[order]
    most = np.concatenate([from_planes(h[4]) for h in held])[order] + least
    entry = np.concatenate([h[0] + np.arange(len(h[1])) for h in held])[order]
    # a context alone with its anchor has no window in common with another one
    near = np.append(lengths[1:] >= anchor, False) | (lengths >= anchor) & (np.arange(len(lengths)) > 0)
    near |= least < most
    some = np.flatnonzero(near)
    lengths = np.where(np.arange(len(lengths)) > 0, lengths, 0)
    shared = np.minimum.reduceat(lengths[:some[-1] + 1], np.concatenate([[0], some[:-1] + 1])) \
        if len(some) else lengths[:0]
    owners = first_owners(rows[some], shared, least[some], window) if len(some) else np.empty((1, 0), np.int64)
    useful = owners < most[some]
    change = np.ones_like(useful)
    change[1:] = owners[1:] != owners[:-1]
    low, who = np.nonzero((change & useful).T)[::-1]  # by context, ascending
    ends = np.append(change[1:], np.ones((1, change.shape[1]), bool), axis=0)
    high = np.nonzero((ends & useful).T)[1]
    values, run = owners[low, who], turns[some[who]]
    out = []
    for r in np.unique(run):
        mine = run == r
        out.append((blocks[r], pack(planes(entry[some[who[mine]]]), low[mine].astype(np.uint8),
                                    high[mine].astype(np.uint8), planes(values[mine]))))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                     "kind": pa.array([FOUND] * len(out), pa.int32()),
                     "payload": pa.array([x for _, x in out], pa.binary())})


# --- answers -------------------------------------------------------------------

def covered(ids: np.ndarray, ends: np.ndarray, n: int, places: tuple, found: list[tuple], window: int) -> np.ndarray:
    """For each byte of a block whether it goes."""
    first, at = places
    steps = np.zeros(n + 1, np.int32)
    bounds = np.append(first, len(at))
    for entry, low, high, owner in found:
        entry, owner = from_planes(entry), from_planes(owner)
        times = bounds[entry + 1] - bounds[entry]
        which = np.repeat(np.arange(len(entry)), times)
        place = at[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + bounds[entry][which]]
        goes = owner[which] < ids[np.searchsorted(ends, place, "right")]
        place, which = place[goes].astype(np.int64), which[goes]
        np.add.at(steps, place - high[which], 1)
        np.add.at(steps, place - low[which] + window, -1)
    return np.cumsum(steps[:n]) > 0


def cut(table: pa.Table, window: int) -> pa.Table:
    """The texts of one block with what is removed from them."""
    places, found = (np.empty(0, np.int32),) * 2, []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
        held = unpack(payload.as_py())
        if kind == DOCS:
            ids, nulls, ends, raw = held
        elif kind == PLACES:
            places = held
        else:
            found.append(held)
    raw = np.frombuffer(raw, np.uint8)
    gone = covered(ids, ends, len(raw), places, found, window)
    spans, kept = [], []
    for a, b in zip(np.concatenate([[0], ends]).tolist(), ends.tolist()):
        edges = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False))
        spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
        kept.append(raw[a:b][~gone[a:b]].tobytes() if spans[-1] else raw[a:b].tobytes())
    return pa.table({
        ID: pa.array([None if x else i for i, x in zip(ids.tolist(), nulls.tolist())], pa.int64()),
        "n_bytes": pa.array(np.diff(ends, prepend=0), pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        "kept": pa.array(kept, pa.binary())})


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, ``spans`` removed (start, end) and the bytes ``kept`` of each text."""
    spark = docs.sparkSession
    anchor = anchor or max(1, min(ANCHOR, window // 2 + 1))
    blocks = stored(gather(docs, window, block), "blocks")
    total = blocks.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_bytes, n_blocks = total["bytes"] or 0, total["n"]
    parts = max(shuffle_partitions(spark), -(-n_bytes // PART))
    width = min(8, -(-(max(n_bytes, 1).bit_length() + 5) // 8) if n_bytes >> 27 else 5)
    keep = max(1, -(-n_blocks * SAMPLES // MOST_SAMPLES))  # one block in so many gives strings
    sample = sorted(bytes(r["x"]) for r in blocks.filter(F.pmod(F.xxhash64("block"), F.lit(keep)) == 0)
                    .select(F.explode("sample").alias("x")).collect())
    borders = np.array(sorted({sample[i * len(sample) // parts][:anchor] for i in range(1, parts)} if sample else set()),
                       dtype=f"S{2 * window - anchor + 2}")

    def tagged(kind: int, rows: DataFrame) -> DataFrame:
        return rows.select("block", F.lit(kind).alias("kind"), "payload")

    sent = send_hashes(blocks, parts, width, window, anchor)
    answers = sent.groupBy("part").applyInArrow(repeats, "block long, payload binary")
    runs = tagged(DOCS, blocks).unionByName(tagged(ANSWER, answers)).groupBy("block").applyInArrow(
        lambda table: make_runs(table, borders, width, window, anchor),
        "part long, block long, kind int, payload binary")
    merged = runs.groupBy("part").applyInArrow(
        lambda table: merge_runs(table, window, anchor), "block long, kind int, payload binary")
    return tagged(DOCS, blocks).unionByName(merged).groupBy("block").applyInArrow(
        lambda table: cut(table, window),
        "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
