import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.operators import blocks
from tandem.operators.em import e_step, m_step, sentence_pairs, train
from tandem.operators.pairs import (
    cooccurrence, null_token, sentence_bags, with_null_word)
from tandem.session import session_conf
from tests.brute import em


def random_bitext(seed, n=40, words=12, longest=9):
    rng = random.Random(seed)
    def side():
        # Square skews the draw: word 1 is in most sentences, some repeat.
        return [1 + int(words * rng.random() ** 2) for _ in range(rng.randint(1, longest))]
    return [(side(), side()) for _ in range(n)]


def frame(spark, bitext):
    rows = [(i, src, tgt) for i, (src, tgt) in enumerate(bitext)]
    return spark.createDataFrame(rows, "sid long, src array<int>, tgt array<int>")


def as_dict(table):
    return {(r.e, r.f): r.p for r in table.collect()}


def assert_close(got, want):
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


@pytest.mark.parametrize("options", [
    {"strategy": "broadcast"},
    {"strategy": "shuffle"},
    {"strategy": "shuffle", "block_pairs": 60},   # hot words are cut into groups
    {"strategy": "broadcast", "broadcast_limit": 1},  # nothing may be broadcast
    {"strategy": "shuffle", "block_pairs": 60, "null_growth": True},
])
def test_train_matches_token_loop(spark, options):
    bitext = random_bitext(7)
    got = as_dict(train(frame(spark, bitext), 4, **options))
    assert_close(got, em(bitext, 4, growth=options.get("null_growth", False)))


def test_zero_rounds_is_relative_cooccurrence(spark):
    bitext = random_bitext(3, n=10)
    assert_close(as_dict(train(frame(spark, bitext), 0)), em(bitext, 0))


def test_text_tokens(spark):
    rows = [(0, ["the", "house"], ["la", "maison"]), (1, ["the", "the"], ["la"])]
    table = train(spark.createDataFrame(rows, "sid long, src array<string>, tgt array<string>"), 2)
    want = em([(s, t) for _, s, t in rows], 2, null="<null>")
    assert_close(as_dict(table), want)


def test_long_sentence_is_cut_into_blocks(spark):
    bitext = [([1, 2], list(range(3, 603))), ([2], [3])]
    assert_close(as_dict(train(frame(spark, bitext), 2, strategy="broadcast")), em(bitext, 2))


def test_empty_sides(spark):
    bitext = [([], [5]), ([4], []), ([4], [5, 6])]
    assert_close(as_dict(train(frame(spark, bitext), 2)), em(bitext, 2))


def test_rows_sum_to_one(spark):
    table = train(frame(spark, random_bitext(1)), 3)
    sums = table.groupBy("e").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9")
    assert sums.count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        train(frame(spark, random_bitext(1, n=2)), 1, strategy="magic")


def test_cooccurrence_counts_tokens(spark):
    got = {(r.e, r.f): r.n for r in cooccurrence(frame(spark, [([1, 1, 2], [7, 7])])).collect()}
    assert got == {(1, 7): 4, (2, 7): 2, (0, 7): 2}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rounds_move_no_pairs_and_cache_none(spark, monkeypatch):
    """A round reads two bucketed tables in place; only need lists are exchanged."""
    plans, real = [], blocks.Tables.write
    monkeypatch.setattr(blocks.Tables, "write", lambda self, df, name: plans.append((name, plan_of(df))) or real(self, df, name))
    for pairs in (10 ** 6, 60):  # the second cuts words into several blocks
        plans.clear()
        train(frame(spark, random_bitext(7)), 2, block_pairs=pairs)
        for name, plan in plans[2:]:
            assert name.startswith("round") and "InMemoryRelation" not in plan and "Bucketed: true" in plan
            moved = set(re.findall(r"Exchange hashpartitioning\(([^#]*)#", plan))
            # need lists by source word, cells of cut words (_w…), and both back to their blocks
            assert {"block", "e"} <= moved and all(m in ("block", "e") or pairs == 60 and m.startswith("_w") for m in moved)
            exchanges = plan.split("Exchange ")[1:]
            assert not any("payload" in part.split("FileScan")[0] for part in exchanges)


def test_blocks_hold_lists_and_need_lists(spark):
    bitext = frame(spark, random_bitext(7))
    null = null_token(bitext)
    bags = with_null_word(sentence_bags(bitext), null)
    laid = blocks.make_blocks(bags, null, 60)
    rows = laid.rows.collect()
    cells = set()
    for r in rows:
        block = blocks.Block(r.payload)
        assert r.n_cells == len(block.cells) and len(set(r.e)) == len(r.e) == block.n_e
        mine = {(r.e[c % block.n_e], r.f[c // block.n_e]) for c in block.cells}
        whole = {(r.e[c % block.n_e], r.f[c // block.n_e]) for i, c in enumerate(block.cells) if i not in r.cut}
        assert not whole & cells  # the cells of words that are not cut are in one block
        cells |= mine
    assert cells == {(r.e, r.f) for r in cooccurrence(bitext).collect()}
    assert laid.cut and len(rows) > 4
    laid.tables.drop()


def test_steps_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "STEP_PAIRS", 7)
    bitext = frame(spark, random_bitext(2, n=12))
    null = null_token(bitext)
    laid = blocks.make_blocks(with_null_word(sentence_bags(bitext), null), null)
    found = {}
    for r in laid.rows.collect():
        block = blocks.Block(r.payload)
        for cell, n in enumerate(block.first_counts()):
            found[r.e[block.cells[cell] % block.n_e], r.f[block.cells[cell] // block.n_e]] = n
    assert found == {(r.e, r.f): r.n for r in cooccurrence(bitext).collect()}
    laid.tables.drop()


def test_two_trainings_at_once_and_any_settings(spark):
    from concurrent.futures import ThreadPoolExecutor

    bitexts = [random_bitext(seed) for seed in (7, 8)]
    before = {t.name for t in spark.catalog.listTables()}
    with ThreadPoolExecutor(2) as pool:
        tables = list(pool.map(lambda b: as_dict(train(frame(spark, b), 3, block_pairs=60)), bitexts))
    for table, bitext in zip(tables, bitexts):
        assert_close(table, em(bitext, 3))
    assert {t.name for t in spark.catalog.listTables()} == before
    with session_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="3"):
        assert_close(as_dict(train(frame(spark, bitexts[0]), 3)), em(bitexts[0], 3))


def test_broadcast_rounds_shuffle_only_counts(spark):
    bitext = frame(spark, random_bitext(5, n=200))
    null = null_token(bitext)
    bags = with_null_word(sentence_bags(bitext), null)
    pairs = sentence_pairs(bags)
    table = m_step(pairs.withColumn("c", F.lit(1.0)), 64, 1 << 20)
    plan = plan_of(e_step(pairs, table, null).groupBy("f", "e").agg(F.sum("share")))
    outside = plan.split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in outside and outside.count("Exchange hashpartitioning") == 1
    assert "Sort " not in outside
    pairs.unpersist()


def test_pairs_of_one_id_are_kept_apart(spark):
    rows = [([1, 2], [5, 6]), ([3, 4], [7, 8]), ([1, 2], [5, 6])]
    schema = "sid long, src array<int>, tgt array<int>"
    same = spark.createDataFrame([(1, *r) for r in rows], schema)
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    tables = [{(r.e, r.f): round(r.p, 9) for r in train(b, 3).collect()} for b in (same, own)]
    assert tables[0] == tables[1]
    assert (1, 7) not in tables[0]


def test_null_and_empty_sides_count_as_empty(spark):
    bitext = spark.createDataFrame([(1, [1], [2]), (2, [], []), (3, None, [2])],
                                   "sid long, src array<int>, tgt array<int>")
    assert {(r.e, r.f) for r in train(bitext, 2).collect()} == {(0, 2), (1, 2)}


def test_state_keeps_counts_of_shared_cells_only(spark, monkeypatch):
    """Cells of a single pair have no number in a round's state, and block and part exchange one row."""
    seen, real = [], blocks.Tables.write

    def write(self, df, name):
        out = real(self, df, name)
        if name.startswith("round"):
            seen.append((self.n, out.select("block", "sums", "counts", "unit").collect()))
        return out

    monkeypatch.setattr(blocks.Tables, "write", write)
    bitext = [([10 * i + j for j in range(5)] + [1], [10 * i + j for j in range(7)] + [1]) for i in range(1, 9)]
    got = as_dict(train(frame(spark, bitext), 3))
    assert_close(got, em(bitext, 3))
    for n, rows in seen:
        counts = sum(len(r.counts) // 8 for r in rows)
        assert 0 < counts < len(got) / 4 and sum(len(r.unit) // 8 for r in rows) == 8 * 8
        assert all(len(r.sums) == n for r in rows)


@pytest.mark.parametrize("growth", [False, True])
def test_many_rounds_of_rare_words(spark, growth):
    """Products of 40 rounds agree with probabilities that are multiplied round by round, down to the smallest."""
    bitext = random_bitext(11, n=25, words=200, longest=12)
    got, want = as_dict(train(frame(spark, bitext), 40, null_growth=growth)), em(bitext, 40, growth=growth)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * want[k] + 1e-300 for k in want)


def test_broadcast_that_does_not_fit_counts_cells_by_blocks(spark, monkeypatch):
    """Asked to broadcast, a table over the limit is counted without an exchange of cells."""
    from tandem.operators import em as module, pairs

    for place in (module, pairs):
        monkeypatch.setattr(place, "cooccurrence_of_bags", lambda bags: pytest.fail("cells were exchanged"), raising=False)
    bitext = random_bitext(4)
    assert_close(as_dict(train(frame(spark, bitext), 2, strategy="broadcast", broadcast_limit=64)), em(bitext, 2))


def test_cooccurrence_exchanges_no_cells(spark):
    """Cells come out of their blocks; a cut word's are added up, and a null token is a token."""
    bitext = frame(spark, random_bitext(6))
    counts = cooccurrence(bitext)
    assert "Exchange" not in plan_of(counts)
    bags = with_null_word(sentence_bags(bitext), null_token(bitext))
    laid = blocks.make_blocks(bags, null_token(bitext), 60)
    assert laid.cut
    cut = {(r.e, r.f): r.n for r in blocks.cell_counts(laid).collect()}
    laid.tables.drop()
    assert cut == {(r.e, r.f): r.n for r in counts.collect()} and len(cut) == counts.count()
    odd = spark.createDataFrame([(1, [None, "a"], ["x", None])], "sid long, src array<string>, tgt array<string>")
    assert {(r.e, r.f, r.n) for r in cooccurrence(odd, with_null=False).collect()} == {
        (e, f, 1) for e in (None, "a") for f in ("x", None)}


def test_posterior_rows_keep_given_ids_without_an_exchange(spark):
    """Shares leave their block with the given id, a null one too; no join on the sentence moves them."""
    from tandem.operators.em import posterior

    bitext = spark.createDataFrame([(None, [1], [5]), ((1 << 60) + 1, [2], [5, 6])], "sid long, src array<int>, tgt array<int>")
    shares = posterior(bitext, train(bitext, 1))
    assert not re.search(r"Exchange hashpartitioning\((given_)?sid", plan_of(shares))
    got = {(r.sid, r.e, r.f) for r in shares.collect()}
    assert got == {(None, e, 5) for e in (0, 1)} | {((1 << 60) + 1, e, f) for e in (0, 2) for f in (5, 6)}


def test_every_block_has_a_part_of_its_own(spark):
    """Numbers 0 to n - 1 collide when they are hashed, and a task gets several whole blocks at once."""
    for n in (1, 2, 7, 57):
        numbers = blocks.block_numbers(spark, n)
        parts = spark.createDataFrame([(x,) for x in numbers], "block int").select(
            F.pmod(F.hash("block"), F.lit(n)).alias("part")).collect()
        assert [r.part for r in parts] == list(range(n)) and len(set(numbers)) == n
    laid = blocks.make_blocks(with_null_word(sentence_bags(frame(spark, random_bitext(7))), null_token(frame(spark, random_bitext(7)))),
                              null_token(frame(spark, random_bitext(7))), 60)
    rows = laid.rows.groupBy(F.input_file_name()).count().collect()
    laid.tables.drop()
    assert len(rows) > 1 and all(r["count"] == 1 for r in rows)


def test_payload_is_narrow_and_compressed():
    import pickle

    import numpy as np

    parts = np.arange(50_000, dtype=np.int32) % 90, blocks.narrow(np.array([-1, 0, 250])), blocks.narrow(np.empty(0, np.int64))
    payload = blocks.packed(parts)
    assert len(payload) * 10 < len(pickle.dumps(parts, 5))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(parts, blocks.unpacked(payload)))
    assert parts[1].tolist() == [-1, 0, 250] and parts[1].dtype == np.int16


def test_a_round_works_on_matrices_and_builds_no_keys(spark, monkeypatch):
    """Sentences of one length follow each other, so that a round needs no list of pairs."""
    import numpy as np

    monkeypatch.setattr(blocks, "STEP_PAIRS", 7)
    bitext = [*random_bitext(5, n=20), ([], [3]), ([4], [])]
    bags = with_null_word(sentence_bags(frame(spark, bitext)), null_token(frame(spark, bitext)))
    laid = blocks.make_blocks(bags, null_token(frame(spark, bitext)), 200)
    rows = laid.rows.collect()
    laid.tables.drop()
    for r in rows:
        block = blocks.Block(r.payload)
        sums, counts = np.zeros(block.n_e), np.zeros(len(block.shared))
        for units, _, unit, at, _, _, shared, place in block.pairs():
            n = block.n_src[at] * block.n_tgt[units].astype(float)[unit]
            sums += np.bincount(block.src[at], n, block.n_e)
            counts += np.bincount(place, n[shared], len(counts))
        monkeypatch.setattr(blocks.Block, "pairs", lambda self: pytest.fail("keys were built"))
        got = block.first_state()
        one = np.full(len(block.shared), 0.25), (got[2][0], got[2][1]), (got[3][0], got[3][1])
        moved = block.round(*one, [1])
        far = block.round(one[0], (one[1][0], one[1][1] + 2000), (one[2][0], one[2][1] - 2000), [1])
        monkeypatch.undo()
        monkeypatch.setattr(blocks, "STEP_PAIRS", 7)
        assert np.array_equal(got[0], sums) and np.array_equal(got[1], counts)
        assert np.allclose(moved[0].sum(), block.n_tgt.sum()) and np.allclose(far[0], moved[0]) and np.allclose(far[1], moved[1])


def test_distinct_keys_by_their_positions():
    import numpy as np

    for keys in ([5, 1, 5, 0, 1, 5], [], [1 << 62, 3, 1 << 62]):
        keys = np.array(keys, np.int64)
        for got, want in zip(blocks.distinct(keys), np.unique(keys, return_inverse=True, return_counts=True)):
            assert np.array_equal(got, want)


def test_steps_number_cells_without_a_search(spark, monkeypatch):
    """A pair's cell is known by its place among the shared cells or the pairs of their own."""
    import numpy as np

    monkeypatch.setattr(blocks, "STEP_PAIRS", 60)
    bags = with_null_word(sentence_bags(frame(spark, random_bitext(8, n=20))), null_token(frame(spark, random_bitext(8, n=20))))
    laid = blocks.make_blocks(bags, null_token(frame(spark, random_bitext(8, n=20))), 200)
    rows = laid.rows.collect()
    laid.tables.drop()
    for r in rows:
        block = blocks.Block(r.payload)
        want = [np.searchsorted(block.cells, keys) for *_, keys, _, _ in block.pairs()]
        searched, real = [], np.searchsorted
        monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **by: searched.append(np.size(v)) or real(a, v, *more, **by))
        got = [cell for *_, cell, _ in blocks.Block(r.payload).steps()]
        monkeypatch.setattr(np, "searchsorted", real)
        assert np.array_equal(np.concatenate(got), np.concatenate(want)) and sum(searched) < len(np.concatenate(want)) / 10


def test_sentences_go_to_blocks_as_messages(spark, monkeypatch):
    """One exchange of compressed arrays, of cut words too; no list of words a sentence and block."""
    plans, real = [], blocks.Tables.write
    monkeypatch.setattr(blocks.Tables, "write", lambda self, df, name: plans.append(plan_of(df)) or real(self, df, name))
    bitext = frame(spark, random_bitext(7))
    laid = blocks.make_blocks(with_null_word(sentence_bags(bitext), null_token(bitext)), null_token(bitext), 60)
    laid.tables.drop()
    assert laid.cut and "MapInArrow" in plans[0] and "src_w" not in plans[0]
    assert len(re.findall(r"Exchange hashpartitioning\(block#", plans[0])) == 1


def test_cells_of_cut_words_travel_as_numbers(spark, monkeypatch):
    """A round exchanges arrays by block and part, also for target words that are in several blocks."""
    plans, real = [], blocks.Tables.write
    monkeypatch.setattr(blocks.Tables, "write", lambda self, df, name: plans.append((name, plan_of(df), df.columns)) or real(self, df, name))
    bitext = random_bitext(7)
    assert_close(as_dict(train(frame(spark, bitext), 3, block_pairs=60)), em(bitext, 3))
    for name, plan, columns in plans[2:]:
        assert name.startswith("round") and set(re.findall(r"Exchange hashpartitioning\(([^#]*)#", plan)) == {"block", "e"}
        assert not any(c.startswith("cut") for c in columns)


def dealt_and_built(pairs, deal_words, monkeypatch, n=3, hot=()):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(blocks, "DEALT_WORDS", deal_words)
    bags = [{"sid": i, "given_sid": None if i == 1 else f"s{i}", "len": len(src), "null": "<null>",
             "src": [{"w": w, "n": src.count(w), "pos": src.index(w)} for w in sorted(set(src), key=str)] + [{"w": "<null>", "n": 1, "pos": -1}],
             "tgt": [{"w": w, "n": tgt.count(w)} for w in sorted(set(tgt), key=str)]} for i, (src, tgt) in enumerate(pairs)]
    lists = [pa.list_(pa.struct([("w", pa.string()), *[(c, pa.int32()) for c in more]])) for more in (("n", "pos"), ("n",))]
    schema = pa.schema([("sid", pa.int64()), ("given_sid", pa.string()), ("len", pa.int32()), ("src", lists[0]), ("tgt", lists[1]), ("null", pa.string())])
    batches = [pa.RecordBatch.from_pylist(bags[a:a + 4], schema) for a in range(0, len(bags), 4)]
    messages = list(blocks._dealt(iter(batches), list(range(n)), pa.array(list(hot), pa.string()), np.array([2] * len(hot), np.int64)))
    messages = sorted(messages, key=lambda x: x.column("block")[0].as_py())
    return len(messages), list(blocks._built(iter(messages), n))


@pytest.mark.parametrize("hot", [(), ("f1", None)])
def test_messages_make_the_same_blocks_however_many_they_are(monkeypatch, hot):
    """Every pair is there once, null words and empty sides included, whatever a message or a step of the build holds."""
    rng = random.Random(9)
    word = lambda c: rng.choice([None, *[f"{c}{int(8 * rng.random() ** 2)}" for _ in range(6)]])
    pairs = [([word("e") for _ in range(rng.randint(0, 5))], [word("f") for _ in range(rng.randint(0, 6))]) for _ in range(30)]
    want = {}
    for src, tgt in pairs:
        for f in tgt:
            for e in [*src, "<null>"]:
                want[e, f] = want.get((e, f), 0) + 1
    some, made = dealt_and_built(pairs, 10 ** 6, monkeypatch, hot=hot)
    monkeypatch.setattr(blocks, "STEP_PAIRS", 7)
    more, again = dealt_and_built(pairs, 9, monkeypatch, hot=hot)
    assert more > 2 * some and len(made) == len(again) == 3
    for all_blocks in (made, again):
        found, units = {}, 0
        for batch in all_blocks:
            row = batch.to_pylist()[0]
            block = blocks.Block(row["payload"])
            units += len(block.tgt)
            assert row["n_cells"] == len(block.cells) and list(block.cells) == sorted(set(block.cells))
            cut = {int(block.cells[i]) // block.n_e for i in row["cut"]}
            assert {row["f"][f] for f in cut} <= set(hot) and all(row["f"][f] not in hot or f in cut for f in range(len(row["f"])))
            for cell, n in enumerate(block.first_counts()):
                key = row["e"][block.cells[cell] % block.n_e], row["f"][block.cells[cell] // block.n_e]
                found[key] = found.get(key, 0) + n
        assert found == want and units == sum(len(set(tgt)) for _, tgt in pairs)


def test_a_round_has_no_number_a_place(spark, monkeypatch):
    """Places of source words are as many as the pairs, so that their factors are worked out step by step."""
    import numpy as np

    bitext = frame(spark, random_bitext(5, n=60))
    laid = blocks.make_blocks(with_null_word(sentence_bags(bitext), null_token(bitext)), null_token(bitext))
    rows = laid.rows.collect()
    laid.tables.drop()
    monkeypatch.setattr(blocks, "STEP_PAIRS", 20)
    seen, real = [], blocks.Block.factors

    def factors(self, *options):
        of = real(self, *options)
        return lambda places, sentence: seen.append(len(sentence)) or of(places, sentence)

    monkeypatch.setattr(blocks.Block, "factors", factors)
    for r in rows:
        block = blocks.Block(r.payload)
        _, counts, unit, word = block.first_state()
        block.round(np.full(len(counts), 0.5), unit, word, [1])
        assert max(seen) <= 30 < len(block.src) and block.n_src.dtype.itemsize == 1
