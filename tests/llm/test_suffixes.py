import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.llm import suffixes
from tandem.llm.common import read_table
from tests.llm.conftest import EDGES, documents


def brute(rows, window):
    """Per row (id, text bytes): spans that go and what is kept."""
    first = {}
    for i, t in rows:
        i = float("inf") if i is None else i
        for a in range(len(t) - window + 1):
            s = t[a:a + window]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - window + 1):
            if first[t[a:a + window]] < (float("inf") if i is None else i):
                gone[a:a + window] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
        out.append((i, len(t), [tuple(e) for e in edges], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=repr)


def result(docs, **options):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))
                   for r in suffixes.dedup(docs, **options).collect()), key=repr)


def encoded(rows):
    return [(i, (t or "").encode()) for i, t in rows]


def passages(n, seed, letters="abcd é", longest=120):
    """Texts that share passages, whole texts and long runs of one letter."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(12)]
    pool += ["a" * rng.randint(1, longest) for _ in range(2)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool)[rng.randint(0, 8):] if rng.random() < 0.6 else
                 "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(-5, n), "".join(parts)))
    return rows


@pytest.mark.parametrize("window, block, seed", [(50, 4 << 20, 1), (50, 900, 2), (12, 300, 3), (7, 64, 4)])
def test_equals_brute_force(spark, window, block, seed):
    rows = passages(80, seed)
    assert result(documents(spark, rows), window=window, block=block) == brute(encoded(rows), window)


def test_edges(edges, nothing):
    assert result(edges) == brute(encoded(EDGES), 50)
    assert result(edges, window=8, block=2000) == brute(encoded(EDGES), 8)
    assert suffixes.dedup(nothing).count() == 0


def test_equal_ids_and_null_ids_keep_their_copies(spark):
    text = "a passage that is certainly longer than fifty bytes, repeated"
    rows = [(3, text), (3, text), (None, text), (None, text + "!"), (9, "x" + text)]
    found = result(documents(spark, rows))
    assert found == brute(encoded(rows), 50)
    assert sum(not spans for _, _, spans, _ in found) == 2
    alone = [(None, text), (None, text)]
    assert all(not spans for _, _, spans, _ in result(documents(spark, alone)))


def test_a_given_table_at_several_block_sizes(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()], 50)
    assert result(docs) == want
    assert result(docs, block=20_000) == want


def test_query_derives_its_columns(spark):
    from tandem.llm.queries import QUERIES

    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = {i: (n, n - len(kept), len(spans)) for i, n, spans, kept in brute(
        [(r.doc_id, (r.text or "").encode()) for r in docs], 50)}
    rows = QUERIES["op13_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in rows} == want


# --- parts -------------------------------------------------------------------

def test_loser_tree_merges_and_tells_common_prefixes():
    rng = random.Random(5)
    for n in (1, 2, 3, 5, 8, 13):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randint(0, 20))}) for _ in range(n)]
        shared = [[suffix_prefix(a, b) for a, b in zip([b""] + r, r)] for r in runs]
        turns, lengths = suffixes.merge(runs, shared)
        at, order = [0] * n, []
        for t in turns:
            order.append(runs[t][at[t]])
            at[t] += 1
        assert order == sorted(sum(runs, []))
        assert lengths[1:] == [suffix_prefix(a, b) for a, b in zip(order, order[1:])]


def suffix_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_known_prefixes_are_not_compared_again(monkeypatch):
    looked = []
    real = suffixes.common_prefix
    monkeypatch.setattr(suffixes, "common_prefix", lambda a, b, start: looked.append(real(a, b, start) - start) or real(a, b, start))
    runs = [sorted(b"same start %05d" % (k * 7 + i * 3) for k in range(200)) for i in range(3)]
    shared = [[suffix_prefix(a, b) for a, b in zip([b""] + r, r)] for r in runs]
    suffixes.merge(runs, shared)
    assert sum(looked) < 3 * 200 * 5  # bytes looked at, far fewer than 11 a comparison


def test_front_coding_is_reversible():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 11)).astype(np.uint8)
    rows = rows[np.argsort(suffixes.as_strings(rows), kind="stable")]
    shared, rest = suffixes.front_code(rows, suffixes.shared_prefixes(rows))
    rows[shared == 11] = rows[np.flatnonzero(shared == 11) - 1] if (shared == 11).any() else 0
    assert len(rest) < rows.size and (suffixes.front_decode(shared, rest, 11) == rows).all()


def test_numbers_survive_packing():
    values = np.array([-(1 << 63), -1, 0, 7, (1 << 63) - 1])
    assert (suffixes.from_planes(suffixes.planes(values)) == values).all()


def test_anchors_are_the_same_in_equal_windows():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 101, 400).astype(np.uint8)
    left = np.concatenate([rng.integers(97, 101, 77).astype(np.uint8), shared])
    a, ha = suffixes.anchors(left, np.array([len(left)]), 50, 26)
    b, hb = suffixes.anchors(shared, np.array([len(shared)]), 50, 26)
    assert set(zip(b, hb)) <= set(zip(a - 77, ha))
    for start in range(len(shared) - 49):
        assert ((b >= start) & (b <= start + 24)).any()


def test_only_repeated_suffixes_are_exchanged(spark):
    rng = random.Random(8)
    own = [(i, "".join(rng.choice("abcdefgh ") for _ in range(3000))) for i in range(40)]
    docs = documents(spark, own + [(99, own[3][1][1000:1400])])
    blocks = suffixes.gather(docs, 50, 4 << 20)
    answers = suffixes.send_hashes(blocks, 3, 5, 50, 26).groupBy("part").applyInArrow(
        suffixes.repeats, "block long, payload binary")
    runs = blocks.select("block", F.lit(suffixes.DOCS).alias("kind"), "payload").unionByName(
        answers.select("block", F.lit(suffixes.ANSWER).alias("kind"), "payload")).groupBy("block").applyInArrow(
        lambda t: suffixes.make_runs(t, np.array([], "S76"), 5, 50, 26),
        "part long, block long, kind int, payload binary").filter(F.col("kind") == suffixes.RUN)
    sent = sum(len(suffixes.unpack(r.payload)[1]) for r in runs.collect())
    assert 0 < sent < 2 * 400 / 6
    assert isinstance(answers.toArrow(), pa.Table)
