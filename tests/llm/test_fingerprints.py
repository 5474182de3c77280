import hashlib

import numpy as np

from tandem.llm.fingerprints import (
    CELLS, as_hex, edited, fingerprint, fingerprints, likeness, samples, weights)
from tests.llm.conftest import EDGES, documents, random_texts


def test_likeness_estimates_generalised_jaccard():
    rng, errors = np.random.default_rng(3), []
    for _ in range(300):
        x = np.zeros(CELLS, np.int64)
        x[rng.integers(0, CELLS, 80)] = rng.integers(1, 9, 80)
        y = x.copy()
        y[rng.integers(0, CELLS, 30)] = rng.integers(1, 9, 30)
        y[rng.choice(np.flatnonzero(x), 25)] = 0
        true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        errors.append(likeness(samples(x), samples(y)) - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.08


def test_edited_texts_against_brute_force(edges):
    rows = edited(edges).collect()
    ordered = sorted(EDGES, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        a, b, c = map(fingerprint, (text, new, after))
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), as_hex(a), as_hex(b),
                     likeness(a, b), likeness(a, c)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_many_buckets(spark):
    texts = random_texts(200)
    docs = documents(spark, list(enumerate(texts)))
    rows = {r.doc_id: r for r in edited(docs).collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        assert rows[i].near_next == likeness(fingerprint(text), fingerprint(after))


def test_equal_texts_and_texts_without_words(edges):
    found = {}
    for r in fingerprints(edges).collect():
        found.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert found[1] == found[6] == found[12]  # case is folded
    assert found[2] == found[3] == found[4] == {"0" * 256}
    assert weights("").sum() == 0


def test_one_row_and_no_row(spark, nothing):
    assert edited(nothing).count() == 0
    row = edited(documents(spark, [(5, "one two three")])).first()
    assert row.near_next == 1.0 and row.n_chars == 13


def test_likeness_of_texts_with_over_30_000_distinct_words():
    words = [f"w{i}" for i in range(120_000)]
    for common in (0, 20_000):  # of 40,000 in each
        x, y = " ".join(words[:40_000]), " ".join(words[40_000 - common:80_000 - common])
        true = common / (80_000 - common)
        assert abs(likeness(fingerprint(x), fingerprint(y)) - true) < (0.2 if common else 0.05)


def test_numbers_have_their_distributions_and_do_not_depend_on_what_came_before(monkeypatch):
    from tandem.llm import fingerprints as module

    r, log_c, b = module.numbers(module.keys_of([b"w%d" % i for i in range(3000)]))
    for found in (r, np.exp(log_c)):  # Gamma(2, 1)
        assert abs(found.mean() - 2) < 0.02 and abs(found.var() - 2) < 0.05 and (found > 0).all()
    assert abs(b.mean() - 0.5) < 0.005 and abs(b.var() - 1 / 12) < 0.002
    texts = random_texts(60, words=4000, longest=3000)
    first = [as_hex(fingerprint(t)) for t in texts]
    monkeypatch.setattr(module, "CELLS", 2500)  # full every few texts
    monkeypatch.setattr(module, "KNOWN", [])
    assert [as_hex(fingerprint(t)) for t in reversed(texts)] == first[::-1]
