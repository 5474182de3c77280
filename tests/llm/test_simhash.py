import numpy as np
import pytest
import xxhash

from tandem.llm import simhash
from tandem.llm.simhash import components, contract, fingerprint, keep, links, similar, spanning
from tests.llm.conftest import documents, random_texts


def near_values(seed=2, n=120):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    found = [base, np.array([0, 1, 3, 1 << 63, (1 << 64) - 1], np.uint64)]
    for flips in range(1, 7):
        some = base[rng.integers(0, n, n)].copy()
        for _ in range(flips):
            some ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        found.append(some)
    return np.unique(np.concatenate(found))


def brute_roots(values, bits=4):
    root = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    return spanning(len(root), [np.nonzero(near)])


@pytest.mark.parametrize("front,leaf", [(64, 1), (1 << 16, 8), (1 << 16, 300)])
def test_trie_join_finds_all_pairs(monkeypatch, front, leaf):
    monkeypatch.setattr(simhash, "FRONT", front)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    v = near_values()
    got = {(min(a, b), max(a, b)) for x, y in similar(v, v, 0, 0, True) for a, b in zip(x.tolist(), y.tolist())}
    near = np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    low, high = v[v < 1 << 63], v[v >= 1 << 63]
    pairs = [(a, b) for x, y in similar(low, high, 1, 1, False) for a, b in zip(x.tolist(), y.tolist())]
    near = np.bitwise_count(low[:, None] ^ high[None, :]) <= 4
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("size", [40, 3])  # 3: nodes beyond their size, in several rows
def test_components_of_links(spark, size):
    v = near_values(n=60)
    v = np.unique(np.concatenate([v, np.arange(12, dtype=np.uint64)]))  # many with one 16-bit prefix
    frame = spark.createDataFrame([(int(x),) for x in v.view("<i8")], "fp long")
    roots = {r.v: r.root for r in contract(links(frame, node_size=size)).collect()}
    want, groups = brute_roots(v), {}
    for value, root in zip(v.view("<i8").tolist(), want.tolist()):
        groups.setdefault(root, set()).add(roots.get(value, value))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_contraction_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    roots = contract(chain).collect()
    assert len(roots) == 301 and len({r.root for r in roots}) == 1
    assert contract(chain.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    texts = random_texts(150, longest=80)
    texts += [t + " more" for t in texts[:40]] + texts[:30] + ["", None, " \n", "A b C", "a B c"]
    rows = {r.doc_id: r for r in components(documents(spark, list(enumerate(texts))), node_size=64).collect()}
    values = []
    for i, t in enumerate(texts):
        found = (t or "").encode().lower().split()
        grams = [b" ".join(found[k:k + 4]) for k in range(max(1, len(found) - 3))] if found else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        values.append(value)
        assert rows[i].fp % (1 << 64) == value
    want = brute_roots(np.array(values, np.uint64))
    assert [rows[i].component_id for i in range(len(texts))] == want.tolist()


def test_keep_and_edges(edges, nothing):
    rows = keep(edges).collect()
    assert rows[0].__fields__ == edges.columns
    by_component = {}
    for r in components(edges).collect():
        by_component.setdefault(r.root, []).append(r.doc_id)
    assert len(rows) == len(by_component)
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(
        str(min((i for i in ids if i is not None), default=None)) for ids in by_component.values())
    assert components(nothing).count() == 0 and keep(nothing).count() == 0


def test_one_id_for_unlike_texts(spark):
    texts = random_texts(2, seed=9, longest=300)
    docs = documents(spark, [(1, texts[0] + " a b c d e"), (1, "quite another text than the first one is")])
    assert keep(docs).count() == 2


def test_fingerprints_of_short_texts():
    assert fingerprint("") == fingerprint(" \t") == 0
    assert fingerprint("one TWO") % (1 << 64) == xxhash.xxh64_intdigest(b"one two", seed=42)
