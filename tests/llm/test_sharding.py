import random
import zlib

import numpy as np

from tandem.llm.sharding import DIMENSIONS, grow_tree, place_large, place_leaves, shard, split_here
from tests.llm.conftest import EDGES, documents, random_texts


def summary(rows, shards):
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return sizes


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    texts = random_texts(1500, words=5000)
    texts += texts[:200]
    rows = shard(documents(spark, list(enumerate(texts))), 7).collect()
    sizes = summary(rows, 7)
    assert len(rows) == len(texts) and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 7
    homes = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_beyond_a_shard_is_divided(spark):
    texts = ["the same text again and again"] * 400 + random_texts(600)
    rows = shard(documents(spark, list(enumerate(texts))), 8).collect()
    sizes = summary(rows, 8)
    assert max(sizes) < 1.2 * sum(sizes) / 8 and len({r.shard for r in rows if r.doc_id < 400}) > 1


def test_large_groups_fill_shards_whole_where_they_fit():
    pieces, filled = place_large([("a", 90), ("b", 60), ("c", 30), ("d", 260)], 4, 110.0)
    assert sum(filled) == 440 and max(filled) <= 111.1
    for digest in "abcd":
        own = sorted(p[1:3] for p in pieces if p[0] == digest)
        assert own[0][0] == 0.0 and own[-1][1] == 1.0
        assert all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_edges(edges, nothing):
    rows = shard(edges, 3).collect()
    summary(rows, 3)
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in EDGES)
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert len({r.shard for r in rows if r.doc_id in (1, 6)}) == 1
    assert shard(nothing, 3).count() == 0


def tree_by_sorting(points, limit, path=""):
    """Leaves of (keys, bytes) by plain weighted medians: the cut whose left side is nearest to half."""
    total = sum(size for _, size in points)
    widths = [max(k[d] for k, _ in points) - min(k[d] for k, _ in points) for d in range(4)]
    if total <= limit or not any(widths):
        return {k: path for k, _ in points}
    dim = widths.index(max(widths))
    half = {cut: sum(size for k, size in points if k[dim] < cut) for cut in {k[dim] for k, _ in points}}
    best = min((abs(2 * left - total), cut) for cut, left in half.items() if left)[1]
    low, high = [p for p in points if p[0][dim] < best], [p for p in points if p[0][dim] >= best]
    return tree_by_sorting(low, limit, path + "0") | tree_by_sorting(high, limit, path + "1")


def random_points(n, seed=3):
    made = random.Random(seed)
    return [(tuple(made.randrange(1 << made.choice((8, 30, 44))) for _ in DIMENSIONS), made.choice((17, 60, 999)))
            for _ in range(n)]


def test_cuts_are_weighted_medians_in_one_task():
    points = random_points(400)
    paths = split_here(np.array([k for k, _ in points]), np.array([s for _, s in points]), 2500.0)
    assert dict(zip((k for k, _ in points), paths)) == tree_by_sorting(points, 2500)


def test_cuts_are_the_same_over_many_tasks(spark):
    points = random_points(300, 5)
    frame = spark.createDataFrame([(str(i), 1, size, *k) for i, (k, size) in enumerate(points)],
                                  "digest string, n long, bytes long, " + ", ".join(f"k_{c} long" for c in DIMENSIONS))
    want = tree_by_sorting(points, 9000)
    for in_task in (1, 60, 1000):
        got = {r.digest: r.path for r in grow_tree(frame, 9000.0, in_task).collect()}
        assert got == {str(i): want[k] for i, (k, _) in enumerate(points)}
    sizes = {}
    for i, (_, size) in enumerate(points):
        sizes.setdefault(got[str(i)], []).append(size)
    assert all(sum(s) <= 9000 or len(s) == 1 for s in sizes.values())


def test_runs_of_leaves_are_even_and_in_the_order_of_the_tree():
    made = random.Random(2)
    leaves = [(format(i, "010b"), made.randrange(50, 200)) for i in range(1000)] + [("11111111111", 5000)]
    total = sum(size for _, size in leaves) + 30_000
    places, pieces = place_leaves(leaves, [("copies", 30_000)], 10, total / 10)
    sizes, home = dict(leaves), dict(places)
    assert sorted(home) == sorted(sizes) and {p[0] for p in pieces} == {"copies"}
    filled = [sum(sizes[p] for p in home if home[p] == s) + sum(
        30_000 * (end - start) for _, start, end, t in pieces if t == s) for s in range(10)]
    assert max(filled) - min(filled) < 0.02 * total / 10
    steps = [home[p] for p in sorted(sizes)]
    assert sum(sizes[p] for p, a, b in zip(sorted(sizes), steps, steps[1:]) if b == a) > 0.6 * (total - 30_000)


def test_a_text_beyond_a_shard_is_whole_and_copies_below_it_stay_together(spark):
    texts = ["long " * 4000] + ["a copy " * 300] * 4 + random_texts(40)
    rows = shard(documents(spark, list(enumerate(texts))), 10).collect()
    assert len(rows) == len(texts) and len({r.shard for r in rows if 1 <= r.doc_id <= 4}) == 1
