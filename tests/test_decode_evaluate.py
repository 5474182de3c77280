import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.operators import blocks
from tandem.operators.decode import align
from tandem.operators.em import posterior, top_translations
from tandem.operators.evaluate import (
    compare_links, confusion, evaluate, gold_of_sentences, missing_gold)
from tandem.operators.links import (
    build_links, invalid_links, link_intersection, link_membership, links_for_source, reverse_links,
    sure_links)
from tandem.operators.pairs import null_token, sentence_bags, with_null_word
from tandem.operators.render import render_alignment
from tests.brute import best_links, scores

BITEXT = "sid long, src array<int>, tgt array<int>"
LINKS = "sid long, e_pos int, f_pos int, sure boolean"
TABLE = "e int, f int, p double"


def links_of(df):
    return {(r.sid, r.e_pos, r.f_pos) for r in df.collect()}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_align_matches_loop_with_ties_and_unseen_words(spark, strategy):
    rng = random.Random(11)
    # Few distinct values, so exact ties between positions and with NULL are common.
    table = {(e, f): rng.choice([0.0, 0.25, 0.5, 1.0])
             for e in range(6) for f in range(1, 7) if rng.random() < 0.8}
    sentences = [(i, [rng.randint(1, 8) for _ in range(rng.randint(0, 6))],
                  [rng.randint(1, 8) for _ in range(rng.randint(0, 6))]) for i in range(80)]
    got = links_of(align(
        spark.createDataFrame(sentences, BITEXT),
        spark.createDataFrame([(e, f, p) for (e, f), p in table.items()], TABLE), strategy))
    want = {(i, e, f) for i, src, tgt in sentences for e, f in best_links(src, tgt, table)}
    assert got == want and got


def test_tie_goes_to_null_then_left(spark):
    # NULL: 0.3 * 0.2 = 0.06 = 0.15 * 0.8 / 2
    table = spark.createDataFrame([(0, 9, 0.3), (1, 9, 0.15), (2, 8, 0.5)], TABLE)
    bitext = spark.createDataFrame([(1, [1], [9]), (2, [2, 2, 2], [8])], BITEXT)
    assert links_of(align(bitext, table, digits=6)) == {(2, 0, 0)}


def test_scores_match_grid_count(spark):
    rng = random.Random(2)
    sizes = {i: (rng.randint(1, 5), rng.randint(1, 5)) for i in range(20)}
    proposed = {(i, rng.randint(0, 6), rng.randint(0, 6)) for i in range(20) for _ in range(6)}
    gold = {(i, rng.randint(0, 6), rng.randint(0, 6)): rng.random() < 0.5
            for i in range(1, 20) for _ in range(8)}
    bitext = spark.createDataFrame([(i, [1] * n, [1] * m) for i, (n, m) in sizes.items()], BITEXT)
    a = spark.createDataFrame([(*k, True) for k in proposed], LINKS)
    g = spark.createDataFrame([(*k, v) for k, v in gold.items()], LINKS)
    row = confusion(compare_links(a, g, bitext)).first()
    assert (row.a_s, row.a_p, row.a, row.s) == scores(sizes, proposed, gold)
    assert [r.sid for r in missing_gold(bitext, g).collect()] == [0]
    assert {r.sid for r in gold_of_sentences(bitext, g).collect() if not r.has_gold} == {0}


def test_perfect_alignment_has_no_error(spark):
    bitext = spark.createDataFrame([(1, [1, 2], [1, 2])], BITEXT)
    links = spark.createDataFrame([(1, 0, 0, True), (1, 1, 1, True)], LINKS)
    row = evaluate(links, links, bitext).first()
    assert (row.precision, row.recall, row.aer) == (1.0, 1.0, 0.0)


def test_nothing_proposed_gives_null_precision(spark):
    bitext = spark.createDataFrame([(1, [1], [1])], BITEXT)
    gold = spark.createDataFrame([(1, 0, 0, True)], LINKS)
    row = evaluate(spark.createDataFrame([], LINKS), gold, bitext).first()
    assert row.precision is None and row.recall == 0.0 and row.aer == 1.0


def test_links(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, False), (1, 0, 0, True), (1, -1, 2, True), (1, 2, 1, False)], LINKS)
    links = build_links(rows)
    assert {tuple(r) for r in links.collect()} == {(1, 0, 0, True), (1, 2, 1, False)}
    assert invalid_links(rows).count() == 1
    twice = reverse_links(reverse_links(links))
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in links.collect()}
    assert links_of(links_for_source(links, 0)) == {(1, 0, 0)} == links_of(sure_links(links))
    member = {tuple(r) for r in link_membership(links, links).collect()}
    assert member == {(1, 0, 0, True, True), (1, 2, 1, False, True)}
    assert links_of(link_intersection(links, links, sure_only=True)) == {(1, 0, 0)}


def test_render(spark):
    bitext = spark.createDataFrame([(1, ["a", "bcd"], ["x", "y"])],
                                   "sid long, src array<string>, tgt array<string>")
    gold = spark.createDataFrame([(1, 0, 0, True), (1, 1, 0, False), (1, 0, 1, False)], LINKS)
    proposed = spark.createDataFrame([(1, 0, 0, True), (1, 1, 1, True), (1, 0, 1, True)], LINKS)
    lines = [r.line for r in render_alignment(bitext, gold, proposed).orderBy("sid", "part", "i").collect()]
    assert lines == ["[#]( )| x", "(#) # | y", "------'", " a  b ", "    c ", "    d "]


def test_posterior_sums_to_one(spark):
    bitext = spark.createDataFrame([(1, [1, 2, 2], [3, 4]), (2, [1], [4])], BITEXT)
    table = spark.createDataFrame([(e, f, 0.1 * (e + 1)) for e in range(3) for f in (3, 4)], TABLE)
    sums = posterior(bitext, table).groupBy("sid", "f").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.s - 1) < 1e-12 for r in sums)


def test_top_translations(spark):
    table = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 3, 0.2), (2, 3, 1.0)], TABLE)
    assert {(r.e, r.f, r["rank"]) for r in top_translations(table, 2).collect()} == {
        (1, 4, 1), (1, 5, 2), (2, 3, 1)}


def test_improbable_words_still_win_over_null(spark):
    bitext = spark.createDataFrame([(1, ["e"], ["f"])], "sid long, src array<string>, tgt array<string>")
    table = spark.createDataFrame([("e", "f", 4e-7), ("<null>", "f", 1e-9)], "e string, f string, p double")
    for digits in (None, 6):
        assert [(r.e_pos, r.f_pos) for r in align(bitext, table, digits=digits).collect()] == [(0, 0)]


def test_a_large_table_is_cut_to_the_test_set(spark):
    bitext = spark.createDataFrame([(1, ["1"], ["2"])], "sid long, src array<string>, tgt array<string>")
    table = spark.range(200_000).selectExpr("cast(id % 700 AS string) AS e", "cast(id AS string) AS f", "0.1D AS p")
    bags = with_null_word(sentence_bags(bitext), null_token(bitext))
    laid = blocks.make_blocks(bags, null_token(bitext))
    routed = [r.given for r in blocks.route_table(laid, table, "auto", 64).collect() if r.given]
    wanted = table.filter("e = '1' and f = '2'").count()
    assert sum(map(len, routed)) == wanted and align(bitext, table).count() == wanted
    laid.tables.drop()


def test_links_without_rounding_choose_the_most_likely(spark):
    rng = random.Random(12)
    rows = [(i, [rng.randint(1, 6) for _ in range(rng.randint(0, 6))], [rng.randint(1, 6) for _ in range(rng.randint(0, 6))])
            for i in range(80)]
    cells = [(e, f, rng.random()) for e in range(0, 7) for f in range(1, 7) if rng.random() < 0.8]
    bitext, p = spark.createDataFrame(rows, BITEXT), {(e, f): x for e, f, x in cells}
    found = links_of(align(bitext, spark.createDataFrame(cells, TABLE)))
    chosen = {(sid, f_pos): e_pos for sid, e_pos, f_pos in found}
    for sid, src, tgt in rows:
        for j, f in enumerate(tgt):
            weights = {-1: 0.2 * p.get((0, f), 0), **{i: 0.8 / (len(src) + 1) * p.get((e, f), 0) for i, e in enumerate(src)}}
            assert weights[chosen.get((sid, j), -1)] == max(weights.values())


def test_every_sentence_has_a_score_row(spark):
    bitext = spark.createDataFrame([(1, ["a"], ["b"]), (2, ["a"], ["b"])], "sid long, src array<string>, tgt array<string>")
    links = spark.createDataFrame([(1, 0, 0, True)], "sid long, e_pos int, f_pos int, sure boolean")
    rows = {r.sid: (r.precision, r.recall) for r in evaluate(links, links, bitext, by_sentence=True).collect()}
    assert rows == {1: (1.0, 1.0), 2: (None, None)}


def test_tasks_of_links_follow_their_number(spark, monkeypatch):
    """A task's links are bounded by pairs of positions, not by their bytes once compressed."""
    from tandem.operators import links
    from tandem.sources.tables import look_alike_gold

    bitext = spark.createDataFrame([(i, ["aa", "ab"] * 5, ["aa", "ba"] * 5) for i in range(12)] + [(99, None, ["aa"])],
                                   "sid long, src array<string>, tgt array<string>")
    want = sorted(map(tuple, look_alike_gold(bitext).collect()))
    monkeypatch.setattr(links, "TASK_PAIRS", 100)
    gold = look_alike_gold(bitext)
    assert links.link_tasks(bitext) == 12 and gold.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, gold.collect())) == want and len(want) == 12 * 25


@pytest.mark.parametrize("strategy,limit", [("shuffle", 1 << 28), ("auto", 1)])
def test_a_table_is_dealt_to_blocks_without_an_exchange_of_cells(spark, strategy, limit):
    """Cells go to the blocks as arrays by their target words, cut words to several blocks."""
    rng = random.Random(3)
    bitext = spark.createDataFrame([(i, [rng.randint(1, 9) for _ in range(5)], [rng.choice([7, 7, rng.randint(1, 9)]) for _ in range(6)])
                                    for i in range(40)], BITEXT)
    cells = [(e, f, rng.choice([None, float("nan"), 0.0, 0.5, rng.random()])) for e in [None, *range(0, 12)] for f in [None, *range(1, 9)]]
    cells += [(1, 7, 2.0), (1, 7, 3.0)]  # the largest of a cell's rows counts
    table = spark.createDataFrame(cells, TABLE)
    bags = with_null_word(sentence_bags(bitext), null_token(bitext))
    laid = blocks.make_blocks(bags, null_token(bitext), 200)
    routed = blocks.route_table(laid, table, strategy, 64, limit)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(e#\d+, f#", plan) and ("hashpartitioning(f" in plan) == (limit == 1)
    rows = routed.collect()
    assert laid.cut and len(rows) == laid.rows.count()
    laid.tables.drop()
    want = {}
    for e, f, p in cells:
        if e is not None and f is not None:
            p = float("-inf") if p is None else p
            old = want.get((e, f), float("-inf"))
            want[e, f] = p if p != p or p > old else old
    for r in rows:
        row = {"given": pa.scalar(r.given, pa.binary())}
        block = blocks.Block(r.payload)
        there, p = blocks.known_cells(block, row), blocks.given_values(block, row)
        for key, known, found in zip(block.cells.tolist(), there, p):
            cell = want.get((r.e[key % block.n_e], r.f[key // block.n_e]))
            assert known == (cell is not None)
            assert found == (0 if cell is None or cell != cell or cell < 0 else cell)


def test_chunks_are_looked_up_one_after_the_other(monkeypatch):
    monkeypatch.setattr(blocks, "ROUTED_CELLS", 3)
    rows = [(5, 0, "a", 0.1), (2, 1, "b", 0.2), (5, 0, "c", 0.3), (5, 1, "a", 0.4), (2, 0, "b", 0.5)]
    batches = [pa.RecordBatch.from_pylist(
        [dict(zip(("block", "f_no", "e", "p"), r)) for r in rows[a:a + 2]],
        pa.schema([("block", pa.int32()), ("f_no", pa.int32()), ("e", pa.string()), ("p", pa.float64())])) for a in (0, 2, 4)]
    made = [r for b in blocks._chunks(iter(batches)) for r in b.to_pylist()]
    assert [r["block"] for r in made] == [2, 5, 2]
    found = []
    for r in made:
        number, f_no, p = blocks.unpacked(r["cells"])
        found += [(r["block"], int(f), r["words"][i], x) for i, f, x in zip(number, f_no, p)]
    assert sorted(found) == sorted(rows)


def test_blocks_stay_in_place_when_a_table_is_looked_up(spark):
    """Only the table's chunks go to the blocks; the blocks themselves are not exchanged."""
    bitext = spark.createDataFrame([(i, [i % 5, i % 3], [i % 4, 9]) for i in range(30)], BITEXT)
    table = spark.createDataFrame([(e, f, 0.1 * (e + 1)) for e in range(4) for f in (0, 1, 9)], TABLE)
    laid = blocks.make_blocks(with_null_word(sentence_bags(bitext), null_token(bitext)), null_token(bitext), 20)
    routed = blocks.route_table(laid, table, "auto", 64)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    moved = [x.split("Scan ")[0] for x in plan.split("Exchange hashpartitioning")[1:]]
    assert moved and not any("payload" in x for x in moved) and "Bucketed: true" in plan
    assert routed.count() == laid.rows.count() > 3
    laid.tables.drop()


def test_pairs_are_written_down_in_columns(spark):
    """Numbered pairs are read back from a file of columns, a fraction of a checkpoint's rows."""
    from tandem.operators.pairs import with_own_key

    bitext = spark.createDataFrame([(1, ["a", None], []), (1, None, ["b"]), (None, ["a"], ["b"])],
                                   "sid long, src array<string>, tgt array<string>").repartition(2)
    keyed = with_own_key(bitext)
    assert "FileScan parquet" in keyed._jdf.queryExecution().executedPlan().toString()
    rows = keyed.collect()
    assert len({r.sid for r in rows}) == 3 and sorted(map(repr, keyed.drop("sid").collect())) == sorted(
        map(repr, bitext.withColumnRenamed("sid", "given_sid").collect()))
