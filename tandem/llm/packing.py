"""Cost-balanced packing of documents into training sequences.

A task tokenizes its documents and packs them in batches of ``batch_tokens``, so
nothing is shuffled and a task holds one batch at most. Within a batch, whole
lengths of ``capacity`` are cut from a document first; these are sequences of
their own. What remains of the documents goes, longest first, to the sequence of
lowest cost that has room, where tokens cost ``n + quadratic * n * n``: the linear
and the attention part. If none has room, the piece is cut and fills the sequence
of lowest cost. A batch opens as many sequences as its tokens fill: full ones,
and for the rest of under ``capacity`` tokens one of each power of two in it, the
lengths that need no padding. So no sequence has padding.

Defined cases: a null or empty text is one token, the end id; documents longer
than a sequence are cut; equal rows are packed each on its own; ids, also null or
repeated ones, are carried along, not used; an empty table has no pieces. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tandem.llm.common import ID, TEXT, id_and_text
from tandem.llm.tokens import coder

END_ID = 1
CAPACITY = 2048
BATCH_TOKENS = 4_000_000
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long, sequence_cost double")


def place(lengths: list[int], capacity: int = CAPACITY, quadratic: float = 1 / CAPACITY):
    """Pieces (document, start, length, sequence, offset); tokens and cost by sequence."""
    pieces, open_at, costs = [], [], []
    rest = []
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, len(open_at), 0))
            open_at.append(capacity)
            costs.append(capacity + quadratic * capacity * capacity)
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    first = len(open_at)
    total = sum(n for n, _, _ in rest)
    sizes = [capacity] * (total // capacity)
    sizes += [1 << b for b in reversed(range((total % capacity).bit_length())) if total % capacity >> b & 1]
    room, cost = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            able = room >= n
            if not able.any():
                able = room > 0
            at = int(np.where(able, cost, np.inf).argmin())
            take = min(n, int(room[at]))
            pieces.append((doc, start, take, first + at, sizes[at] - int(room[at])))
            room[at] -= take
            cost[at] += take + quadratic * take * take
            n, start = n - take, start + take
    return pieces, open_at + sizes, costs + cost.tolist()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         quadratic: float = 1 / CAPACITY, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row a piece, its token ids in ``ids`` (little-endian unsigned 32-bit).

    A document's ids are those of ``tokenizer`` (a file of the tokenizers library,
    byte-level), then ``end_id``. ``sequence_id`` is unique, not dense.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(tokenizer, True)
        next_sequence = TaskContext.get().partitionId() << 36
        ids, coded, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_sequence, ids, coded, held
            pieces, tokens, costs = place([len(c) // 4 for c in coded], capacity, quadratic)
            for a in range(0, len(pieces), 4096):
                part = pieces[a:a + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d, *_ in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([coded[d][4 * s:4 * (s + n)] for d, s, n, _, _ in part], pa.binary()),
                    pa.array([len(coded[d]) // 4 for d, *_ in part], pa.int64()),
                    pa.array([next_sequence + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array([tokens[p[3]] for p in part], pa.int64()),
                    pa.array([costs[p[3]] for p in part], pa.float64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset",
                     "sequence_tokens", "sequence_cost"])
            next_sequence += len(tokens)
            ids, coded, held = [], [], 0

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                new = [c + end for c in encoder.encode(part.column(TEXT).to_pylist())]
                ids += part.column(ID).to_pylist()
                coded += new
                held += sum(map(len, new)) // 4
                if held >= batch_tokens:
                    yield from flush()
        yield from flush()

    return id_and_text(docs).mapInArrow(run, SCHEMA)
