import zlib
from collections import Counter

import numpy as np
import pytest

from tandem.llm import quality, toxicity
from tandem.llm.common import read_table
from tandem.llm.labelled import logistic, sigmoid, temperature
from tests.llm.conftest import EDGES, LABELS, documents, random_texts


def labelled(spark):
    """Texts in good order or shouted, and some with one of a few rude words."""
    texts = random_texts(240, longest=40)
    docs, labels = [], []
    for i, t in enumerate(texts):
        good, rude = int(i % 4 != 0), int(i % 5 == 0)
        t = t + " plain words here to end"
        t = t if good else " ".join(w.upper() + "!!" for w in t.split())
        t = t + " you grobbler grobbling" * 2 if rude else t
        docs.append((i, t))
        labels.append((i, good, rude))
    return documents(spark, docs), spark.createDataFrame(labels, LABELS), labels


@pytest.mark.parametrize("module,label,folds,held", [(quality, 1, 5, 0), (toxicity, 2, 3, 1)])
def test_held_out_rows_of_a_clear_case(spark, module, label, folds, held):
    docs, labels, rows = labelled(spark)
    truth = {r[0]: r[label] for r in rows}
    found = module.scores(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
    out = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module, edges, nothing):
    docs, labels, _ = labelled(spark)
    more = labels.unionByName(spark.createDataFrame(
        [(None, 1, 1), (1, None, None), (1, 1, 0), (999, 0, 1)], LABELS))
    both = docs.unionByName(documents(spark, [(i + 1000 if i is not None else None, t) for i, t in EDGES]))
    rows = module.scores(both, more).collect()
    assert len(rows) == 240 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        if r.doc_id in (1001, 1006):
            by_text.setdefault("same", set()).add(r.score)
        if r.doc_id in (1002, 1003, 1004):
            by_text.setdefault("none", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    none = labels.limit(0)
    assert {r.score for r in module.scores(edges, none).collect()} == {0.5}
    assert module.scores(nothing, none).count() == 0 and module.scores(nothing, labels).count() == 0
    kept = module.keep(edges, none, threshold=0.4 if module is quality else 0.6)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)


def test_held_out_labels_are_not_learned(spark):
    docs, labels, rows = labelled(spark)
    turned = spark.createDataFrame(
        [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t)
         for i, q, t in rows], LABELS)
    for module in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in module.scores(docs, x).collect()} for x in (labels, turned))
        assert a == pytest.approx(b)


@pytest.mark.parametrize("module,name,least", [(quality, "quality", 0.93), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy_on_the_given_table(spark, module, name, least):
    folder = "/root/testdata/sf0.01"
    labels = read_table(spark, folder, "labels")
    truth = {r.doc_id: r[name] for r in labels.collect()}
    found = [r for r in module.scores(read_table(spark, folder, "documents"), labels).collect()
             if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) >= least


@pytest.mark.parametrize("module,name", [(quality, "quality"), (toxicity, "toxic")])
def test_few_labels_still_decide(spark, module, name):
    """Both labels are known, but the quarter set aside may hold one only."""
    odd = [i for i in range(60) if zlib.crc32(str(i).encode()) % module.FOLDS != module.HELD_OUT][5:7]
    docs = [(i, f"plain words number {i} in a row " + ("grobbler grobbling " * 4 if i in odd else "to end"))
            for i in range(60)]
    rows = [(i, int(i not in odd), int(i in odd)) for i in range(60)]
    scores = {r.doc_id: r.score for r in module.scores(documents(spark, docs), spark.createDataFrame(rows, LABELS)).collect()}
    rare, rest = [scores[i] for i in odd], [s for i, s in scores.items() if i not in odd]
    assert max(rare) < min(rest) if name == "quality" else min(rare) > max(rest)


def test_a_word_counts_the_same_whatever_is_asked_with_it():
    rng = np.random.default_rng(4)
    words = [b"".join(rng.choice([b"a", b"b", b"\xc3\xa9"], 5)) for _ in range(3000)]
    grams = sorted({g for w in words[::3] for p in toxicity.parts_of(w.decode()) for g in toxicity.grams(p)})
    codes, size = toxicity.code_points(grams)
    keys = toxicity.gram_keys(codes, toxicity.ORDER)[np.cumsum(size) - size]
    model = (np.sort(keys), rng.normal(size=len(keys)))
    alone = [toxicity.word_ratios([w], model)[0] for w in words]
    assert toxicity.word_ratios(words, model) == alone
    assert toxicity.word_ratios(words[::-1] + [b"", b"..."], model)[:3000] == alone[::-1]


def test_scores_do_not_depend_on_the_layout(spark):
    docs, labels, _ = labelled(spark)
    for module in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in module.scores(d, labels).collect()}
                for d in (docs.coalesce(1), docs.repartition(7, "text")))
        assert a == pytest.approx(b, abs=1e-12)


def brute_model(counts):
    """The same two models with dictionaries, as a function of (history, character)."""
    order = toxicity.ORDER
    level = set(counts)
    types = {}
    for k in range(order - 1, 0, -1):
        types[k] = Counter(g[1:] for g in level)
        level = set(types[k])

    def discount(values):
        ones, twos = (sum(v == x for v in values) for x in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def shared(gram):
        k, h = len(gram), gram[:-1]
        q = shared(gram[1:]) if k > 1 else 1 / (len(types[1]) + 1)
        own = {g: n for g, n in types[k].items() if g[:-1] == h}
        if not own:
            return q
        d = discount(types[k].values())
        return (max(own.get(gram, 0) - d, 0) + d * len(own) * q) / sum(own.values())

    def probability(y, gram):
        own = {g: n[y] for g, n in counts.items() if g[:-1] == gram[:-1] and n[y]}
        if not own:
            return shared(gram[1:])
        d = discount([n[y] for n in counts.values()])
        return (max(own.get(gram, 0) - d, 0) + d * len(own) * shared(gram[1:])) / sum(own.values())

    return probability


def test_word_ratios_against_brute_force(spark):
    counts = {}
    for word, n0, n1 in [("idiot", 0, 30), ("the", 90, 90), ("then", 60, 50), ("idea", 30, 30), ("odd", 1, 0),
                         ("tho", 2, 1), ("od", 1, 2)]:
        for g in toxicity.grams(word):
            a, b = counts.get(g, (0, 0))
            counts[g] = (a + n0, b + n1)
    model = toxicity.compile_model(spark.createDataFrame(
        [(g, *n) for g, n in counts.items()], "gram string, n0 long, n1 long"))
    p = brute_model(counts)
    words = [b"idiot", b"IDIOT!!", b"the", b"idiotic", b"odds", b"", b"quite", b"then-idea"]
    want = [sum(np.log(p(1, g) / p(0, g)) for part in toxicity.parts_of(w.decode()) for g in toxicity.grams(part))
            for w in words]
    found = toxicity.word_ratios(words, model)
    assert found == pytest.approx(want, abs=1e-5)
    assert found[0] > 1.5 > abs(found[2]) and found[5] == 0
    letters = {g[-1] for g in counts} | {"\x00"}  # and one for all others
    for y in (0, 1):
        for h in (toxicity.START * 6, toxicity.START * 5 + "i", toxicity.START * 4 + "zz"):
            assert sum(p(y, h + c) for c in letters) == pytest.approx(1)


def test_fitting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    assert np.allclose(logistic(x, y, 1e-6), [2, -1, 0.5], atol=0.25)
    assert temperature(3 * (2 * x[:, 0] - x[:, 1] + 0.5), y) == pytest.approx(3, abs=0.4)


def test_contexts_against_brute_force(spark):
    texts = random_texts(30, words=20, longest=12) + ["", "one", "a b"]
    index, want = quality.index_vectors().astype(int), np.zeros((quality.CELLS, quality.SIZE), int)
    for t in texts:
        cells = np.frombuffer(b"".join(quality.cells_of(w) for w in t.encode().split()), "<i4")
        for i, c in enumerate(cells):
            for j in range(max(0, i - 2), min(len(cells), i + 3)):
                if i != j:
                    want[c] += index[cells[j]]
    assert (quality.contexts(documents(spark, list(enumerate(texts)))) == want).all()


@pytest.mark.parametrize("module,label", [(quality, 1), (toxicity, 2)])
def test_scores_do_not_depend_on_how_many_rows_of_a_label_are_taken(spark, module, label):
    """Half of the texts of one label, a twelfth of the other carry a sign; a score is its probability."""
    rng = np.random.default_rng(6)
    docs, labels, signs = [], [], {}
    for i, t in enumerate(random_texts(6000, longest=30)):
        y = int(rng.random() < (0.88 if module is quality else 0.12))
        common = 1 if module is quality else 0
        signs[i] = rng.random() < (1 / 12 if y == common else 1 / 2)
        docs.append((i, f"{t} plain words " + ("grobbler grobbling " * 3 if signs[i] else "to end")))
        labels.append((i, y, y))
    docs, labels = documents(spark, docs), spark.createDataFrame(labels, LABELS)
    means = []
    for rows in (10_000, 400):
        found = docs.withColumn("s", module.scorer(docs, labels, rows)).select("doc_id", "s").collect()
        means.append([np.mean([r.s for r in found if signs[r.doc_id] == x]) for x in (False, True)])
    # 400 rows of a label are noisy; without weights the means move by 0.3
    assert np.allclose(means[0], means[1], atol=0.2)
