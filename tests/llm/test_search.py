import re
from math import floor, log

import duckdb
import pytest

from tandem.llm import search
from tandem.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import EDGES, documents, random_texts

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall((text or "").encode().lower().decode())


def brute(docs, items, top=10):
    found = [(i, terms(t)) for i, t in docs]
    held = [t for _, t in found if t]
    n_docs, length = len(held), sum(map(len, held))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, ts in found:
            if not ts:
                continue
            m, score = 10 + 90 * len(ts) * n_docs // length, 0
            for w in words & set(ts):
                df = sum(w in set(t) for t in held)
                tf = ts.count(w)
                score += floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) * (10 ** 9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def result(docs, items, **options):
    return sorted(map(tuple, search.rank(docs, items, **options).collect()), key=repr)


ITEMS = [(1, "Same words; TWICE"), (2, None), (3, ""), (4, "é 中文 ñ 12345"), (5, "w1 w2 w996, w1"), (None, "row"),
         (6, "nothing of this occurs"), (7, "x" * 30_000), (5, "repeated"), (8, "no"), (8, "no")]


def table(spark, items):
    return spark.createDataFrame([(i, t, 1, 0.5) for i, t in items], "item_id long, text string, rank int, score double")


def test_edges_and_empty_tables(spark, edges, nothing):
    items = table(spark, ITEMS)
    assert result(edges, items) == brute(EDGES, ITEMS)
    assert result(nothing, items) == [] and result(edges, table(spark, [])) == []


@pytest.mark.parametrize("top, group_bytes", [(10, 1 << 20), (3, 40)])
def test_equals_brute_force_in_any_number_of_groups(spark, top, group_bytes):
    texts = random_texts(150, seed=4, words=40)
    rows = [(i % 140, t) for i, t in enumerate(texts + texts[:20])]  # ties and repeated ids
    items = [(k, t) for k, t in enumerate(random_texts(12, seed=5, words=60, longest=9))]
    assert result(documents(spark, rows), table(spark, items), top=top, group_bytes=group_bytes) == brute(rows, items, top)


def test_terms_do_not_match_inside_others():
    made = search.Terms([["art", "Art of", "é"]])
    n, found = search.counts("ART, artful part;of-art art of of É é", made.automaton())
    assert n == 9 and {made.words[k]: v for k, v in found.items()} == {"art": 3, "of": 1, "é": 1}


def test_a_task_keeps_no_more_than_the_best(spark):
    best = search.Best(1, 2)
    import numpy as np
    best.add([5, 3, None, 4, 1], np.array([[7], [7], [7], [0], [7]]))
    assert sorted(best.heaps[0]) == [(7, True, -3), (7, True, -1)]


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    frame = QUERIES["op12_lexical_search"](spark, folder)
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        found = db.execute(ORACLES["op12_lexical_search"])
        names = [d[0] for d in found.description]
        want = sorted(found.fetchall())
    assert sorted(map(tuple, frame.select(*names).collect())) == want and len(want) > 300
