import zlib
from collections import Counter
from math import log10

import numpy as np

from tandem.llm import brown
from tandem.llm.brown import CLASSES, END, Around, Model, Types, exchange, scores
from tests.llm.conftest import EDGES, documents, random_texts


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def trains(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def check_base(docs, rows):
    counts = Counter(w for i, t in docs if trains(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        found = words_of(t)
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in found)
        want.append((str(i), not trains(i), len(found), sum(w in counts for w in found), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_counts_and_base_against_brute_force(spark, monkeypatch, edges):
    monkeypatch.setattr(brown, "CHUNK_TOKENS", 500)
    check_base(EDGES, scores(edges).collect())
    docs = list(enumerate(random_texts(300)))
    rows = scores(documents(spark, docs)).collect()
    check_base(docs, rows)
    assert all(r.score < 0 for r in rows)


def test_the_model_is_better_on_texts_with_an_order(spark):
    rng = np.random.default_rng(4)
    names = [[f"{c}{i}" for i in range(40)] for c in "abc"]  # words of three kinds in turn
    docs = [(i, " ".join(names[k % 3][rng.integers(40)] for k in range(60))) for i in range(300)]
    held = [r for r in scores(documents(spark, docs)).collect() if r.held_out]
    assert len(held) > 20
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def likelihood(bigrams, of, classes):
    member = np.eye(classes)[of]
    n = member.T @ bigrams @ member
    x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
    return x(n) - x(n.sum(1)) - x(n.sum(0))


def test_exchange_never_falls_and_stops_where_no_move_helps():
    rng = np.random.default_rng(1)
    bigrams = rng.poisson(0.4, (40, 40)) + rng.poisson(6, (40, 40)) * (np.arange(40)[:, None] % 4 == np.arange(40) % 4)
    before = [likelihood(bigrams, exchange(bigrams, 5, r), 5) for r in range(5)]
    assert all(b >= a - 1e-9 for a, b in zip(before, before[1:]))
    of = exchange(bigrams, 5, 50)
    best = likelihood(bigrams, of, 5)
    for w in range(40):
        for k in range(5):
            moved = of.copy()
            moved[w] = k
            assert likelihood(bigrams, moved, 5) <= best + 1e-6


def test_the_rest_has_a_class_to_itself():
    bigrams = np.random.default_rng(6).poisson(0.6, (30, 30))
    of = exchange(bigrams, 4, 50, rest=True)
    assert of[-1] == 4 and set(of[:-1]) <= set(range(4))
    best = likelihood(bigrams, of, 5)
    for w in range(29):
        for k in range(4):
            moved = of.copy()
            moved[w] = k
            assert likelihood(bigrams, moved, 5) <= best + 1e-6


def brute_class(counts, places):
    """Moves a word from the rare class to each other in turn and takes the one of best likelihood."""
    x = lambda v: sum(n * np.log(n) for n in np.ravel(v) if n > 0)
    left, right = places[:CLASSES + 1], places[CLASSES + 1:]
    best = []
    for k in range(CLASSES):
        moved = counts.astype(float).copy()
        moved[:, CLASSES] -= left
        moved[CLASSES] -= right
        moved[:, k] += left
        moved[k] += right
        best.append(round(x(moved) - x(moved.sum(1)) - x(moved.sum(0)), 6))
    return int(np.argmax(best))


def brute_scores(docs, own):
    """The model once more, word by word, in plain Python."""
    train = [words_of(t) for i, t in docs if trains(i)]
    uses = Counter(w for found in train for w in found)
    number = {w: i for i, w in enumerate(own)}
    bigrams = np.zeros((len(own) + 1, len(own) + 1), int)
    for found in train:
        for a, b in zip([END] + found, found):
            bigrams[number.get(a, len(own)), number.get(b, len(own))] += 1
    of = exchange(bigrams, rest=True)
    member = np.eye(CLASSES + 1)[of]
    table = member.T @ bigrams @ member
    side = lambda w: of[number.get(w, len(own))]
    places = {}
    for found in train:
        for a, w, b in zip([END] + found, found, found[1:] + [END]):
            if w not in number:
                at = places.setdefault(w, np.zeros(2 * (CLASSES + 1), int))
                at[side(a)] += 1
                at[CLASSES + 1 + side(b)] += 1
    classes = {w: int(of[i]) for w, i in number.items()} | {w: brute_class(table, x) for w, x in places.items()}
    classes = {w: k for w, k in classes.items() if uses[w]}
    total, words, ones, twos = (np.zeros(CLASSES) for _ in range(4))
    for w, k in classes.items():
        total[k] += uses[w]
        words[k] += 1
        ones[k] += uses[w] == 1
        twos[k] += uses[w] == 2
    d = [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(ones, twos)]
    unknown = np.array([d[k] * words[k] / total[k] if total[k] else 1 for k in range(CLASSES)])
    moves = np.zeros((CLASSES, CLASSES))
    for found in train:
        for a, b in zip([END] + found, found):
            moves[classes[a], classes[b]] += 1
    share = (moves.sum(0) + 1) / (moves.sum() + CLASSES)
    step = (moves + 20 * share) / (moves.sum(1, keepdims=True) + 20)
    mean = share * unknown / (share * unknown).sum() @ step
    for row in [*step, mean]:
        known = sum(row[classes[w]] * (uses[w] - d[classes[w]]) / total[classes[w]] for w in classes)
        assert np.isclose(known + row @ unknown, 1)  # all words and the unknown one
    result = {}
    for i, t in docs:
        score, row = 0.0, step[classes[END]]
        for w in words_of(t):
            if w in classes:
                k = classes[w]
                score += log10(row[k] * (uses[w] - d[k]) / total[k])
                row = step[k]
            else:
                score += log10(row @ unknown)
                row = mean
        result[i] = score
    return result


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(brown, "OWN", 12)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{int(rng.exponential(12))}" if k % 3 else f"V{int(rng.exponential(4))}"
                         for k in range(int(rng.integers(0, 60))))) for i in range(150)]
    uses = Counter(w for i, t in docs if trains(i) for w in words_of(t) if w != END)
    own = [END] + sorted(uses, key=lambda w: (-uses[w], w))[:11]
    want = brute_scores(docs, own)
    got = {r.doc_id: r.score for r in scores(documents(spark, docs)).collect()}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[i], want[i]) for i in got)


def test_classes_of_rare_words_do_not_depend_on_batches(spark, monkeypatch):
    docs = documents(spark, list(enumerate(random_texts(200))))
    first = {r.doc_id: r.score for r in scores(docs).collect()}
    monkeypatch.setattr(brown, "FLUSH", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = {r.doc_id: r.score for r in scores(docs.repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.isclose(first[i], again[i]) for i in first) and first.keys() == again.keys()


def test_places_beside_a_word_by_brute_force():
    rng = np.random.default_rng(3)
    of = rng.integers(0, CLASSES, 200)
    of[-1] = CLASSES
    bigrams = rng.poisson(0.5, (200, 200))
    bigrams[-1] += 9  # rare words stand beside any
    bigrams[:, -1] += 9
    member = np.eye(CLASSES + 1)[of]
    places = rng.poisson(0.08, (300, 2 * (CLASSES + 1)))
    for row in places:  # as many neighbours on either side
        short = row[:CLASSES + 1].sum() - row[CLASSES + 1:].sum()
        row[CLASSES + 1 if short > 0 else 0] += abs(short)
    table = member.T @ bigrams @ member
    assert Around(bigrams, of).classes(places).tolist() == [brute_class(table, row) for row in places]


def test_types_and_shares():
    assert Types(["", "a"]).of(["", "a", "xyz"]).tolist() == [0, 1, 2]
    sums = np.zeros((CLASSES, 4), int)
    sums[3] = 18, 5, 2, 1
    model = Model(Types([END]), np.array([0]), np.array([4]), sums)
    assert (model.tokens, model.distinct) == (22, 6)
    found = 10 ** model.in_class(np.array([1, 1, 2, 5, 9]), np.full(5, 3))
    assert np.isclose(found.sum() + model.unknown[3], 1)


def test_nothing_to_learn_from(spark, nothing):
    assert scores(nothing).count() == 0
    alone = next(i for i in range(100) if not trains(i))
    row = scores(documents(spark, [(alone, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)
