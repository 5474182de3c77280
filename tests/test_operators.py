import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.functions.links import is_possible, is_sure, link_text
from tandem.functions.text import (
    sgml_id, sgml_words, split_single_whitespace, split_spaces, split_whitespace)
from tandem.operators import counts as C
from tandem.operators import order as O
from tandem.operators import sets as S
from tandem.operators.display import format_pair
from tandem.operators.joins import hot_keys, lookup_join
from tandem.operators.vocab import (
    bitext_lines, encode_bitext, encode_lines, first_seen_vocab, vocab_growth, vocab_size)
from tandem.session import checkpoint_dir, session_conf


def words(spark, expr, line):
    return spark.createDataFrame([(line,)], "value string").select(expr(F.col("value"))).first()[0]


@pytest.mark.parametrize("line,want", [
    ("a b", ["a", "b"]), ("a  b", ["a", "", "b"]), (" a", ["", "a"]), ("a  ", ["a"]), ("", [""]), ("  ", [])])
def test_split_spaces(spark, line, want):
    assert words(spark, split_spaces, line) == want


def test_tokenizers_differ(spark):
    assert words(spark, split_single_whitespace, " a\t b ") == ["a", "", "b"]
    assert words(spark, split_whitespace, " a\t b ") == ["a", "b"]


def test_sgml(spark):
    assert words(spark, sgml_words, "<s snum=0012> a b </s>") == ["a", "b"]
    assert words(spark, sgml_id, "<s snum=0012> a b </s>") == 12
    assert words(spark, sgml_id, "a b") == -1


def test_global_index_is_dense(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    rows = O.with_global_index(df, "k", name="n", start=0).collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 1000


def test_running_total(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "x")
    rows = O.running_total(df, "x", "x", "t").collect()
    assert all(r.t == r.x * (r.x + 1) // 2 for r in rows) and len(rows) == 100


def test_skip_take(spark):
    df = spark.range(50)
    assert sorted(r.id for r in O.skip_take(df, "id", offset=10, limit=5).collect()) == list(range(10, 15))
    assert O.skip_take(df, "id", offset=60).count() == 0
    assert O.short_input_report(df, 60).first().too_short
    assert O.take_per_partition(df.repartition(4), 2).count() == 8
    assert [r.id for r in O.sort_rows(df, F.desc("id")).take(2)] == [49, 48]


def test_skip_does_not_gather_rows(spark):
    plan = O.skip_take(spark.range(50), "id", offset=10)._jdf.queryExecution().executedPlan().toString()
    # Spark's own OFFSET would put every row into one partition.
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan


@pytest.mark.parametrize("limit", [None, 1])
def test_lookup_join_with_hot_key(spark, limit):
    big = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("w"), F.col("id").cast("string"))).alias("word"))
    table = spark.createDataFrame([("hot", 1), ("w3", 2), ("w9", 3)], "word string, n int")
    assert [r.word for r in hot_keys(big, ["word"]).collect()] == ["hot"]
    inner = lookup_join(big, table, ["word"], broadcast_limit=limit)
    assert inner.count() == 602
    left = lookup_join(big, table, ["word"], "left", broadcast_limit=limit)
    assert left.count() == 900 and left.filter("n is null").count() == 298


def test_vocabulary_and_encoding(spark):
    rows = [(2, ["b", "a", "b"], ["x", "a"]), (1, ["a", "c"], ["y"])]
    bitext = spark.createDataFrame(rows, "sid long, src array<string>, tgt array<string>")
    vocab = first_seen_vocab(bitext_lines(bitext), F.col("words"))
    ids = {r.word: r.id for r in vocab.collect()}
    assert ids == {"a": 1, "c": 2, "b": 3, "y": 4, "x": 5}
    assert vocab_size(vocab).first().n_words == 5
    back = {i: w for w, i in ids.items()}
    for limit in (None, 1):
        for r in encode_bitext(bitext, vocab, broadcast_limit=limit).collect():
            src, tgt = next((s, t) for i, s, t in rows if i == r.sid)
            assert [back[i] for i in r.src] == src and [back[i] for i in r.tgt] == tgt


def test_vocab_growth(spark):
    tokens = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a"), ("f3", "c")], "file string, word string")
    rows = {r.file: (r.n_new, r.n_words) for r in vocab_growth(tokens).collect()}
    assert rows == {"f1": (2, 2), "f2": (0, 2), "f3": (1, 3)}


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "e int, f int, n double")


def test_counts(spark):
    a, b = cells(spark, (1, 1, 2.0), (1, 2, 6.0)), cells(spark, (1, 1, 1.0), (2, 1, 0.0))
    merged = {(r.e, r.f): r.n for r in C.merge_counts(a, b).collect()}
    assert merged == {(1, 1): 3.0, (1, 2): 6.0, (2, 1): 0.0}
    assert C.increment(a, cells(spark, (1, 2, 0.5))).filter("f = 2").first().n == 6.5
    shares = {(r.e, r.f): r.p for r in C.normalize_rows(a.unionByName(b.filter("e = 2"))).collect()}
    assert shares == {(1, 1): 0.25, (1, 2): 0.75, (2, 1): None}
    over = {(r.e, r.f): r.n for r in C.upsert_counts(a, b).collect()}
    assert over == {(1, 1): 1.0, (1, 2): 6.0, (2, 1): 0.0}
    versions = b.withColumn("v", F.lit(1)).unionByName(cells(spark, (1, 1, 9.0)).withColumn("v", F.lit(2)))
    assert C.upsert_counts(a, versions, version="v").filter("e = 1 and f = 1").first().n == 9.0
    both = cells(spark, (1, 1, 3.0), (1, 1, 8.0), (1, 1, 5.0)).select("e", "f", "n", F.lit(1).alias("v"), (-F.col("n") % 4).alias("at"))
    for parts in (1, 3):  # arrivals -3, 0 and -1
        assert C.upsert_counts(a, both.repartition(parts), version="v", arrival="at").filter("e = 1 and f = 1").first().n == 8.0
    looked = C.lookup_cells(b.select("e", "f"), a.withColumnRenamed("n", "p"))
    assert {(r.e, r.p) for r in looked.collect()} == {(1, 2.0), (2, 0.0)}


def test_arrays_of_a_row(spark):
    rows = spark.createDataFrame([(["b", "a", "ccc"], ["a", "dd"], [1, 2]), ([], ["x"], None)],
                                 "x array<string>, y array<string>, n array<long>")
    found = rows.select(S.union_in_row("x", "y").alias("u"), S.total_in_row("n").alias("t"), S.sorted_in_row(
        "x", F.length, lambda w: w, reverse=True).alias("s")).collect()
    assert [(r.u, r.t, r.s) for r in found] == [(["b", "a", "ccc", "dd"], 3, ["ccc", "b", "a"]), (["x"], 0, [])]


def test_shards_lists_totals(spark):
    bitext = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["a"])], "sid long, src array<string>")
    foot = {r.e: r.shards for r in C.shard_footprint(C.with_shard(bitext, 2)).collect()}
    assert foot == {"a": [1, 2], "b": [2]}
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    values = spark.createDataFrame([(1, 5), (1, 4)], "k int, v int")
    lists = {r.k: r["values"] for r in C.group_to_list(values, "k", "v", keys).collect()}
    assert lists == {1: [4, 5], 2: []}
    assert C.total(values.filter("k > 9"), F.col("v")).first().total == 0


def test_sets(spark):
    a, b = spark.range(3), spark.range(2, 5)
    assert S.set_union(a, b).count() == 5
    assert S.concat_ordered(a, b).groupBy("part_idx").count().count() == 2
    nested = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "k int, v array<string>")
    assert [(r.k, r.pos, r.value) for r in S.flatten_two_level(nested, F.col("v"), "k").collect()] == [
        (1, 0, "x"), (1, 1, "y")]


def test_display(spark):
    pair = spark.createDataFrame([(1, ["a", "b"], ["c"])], "sid long, src array<string>, tgt array<string>")
    assert format_pair(pair).first().text == "0:a 1:b \n0:c \n"
    rows = spark.createDataFrame([(1, 2, True, None), (1, 2, False, None), (1, 2, False, 0.5)],
                                 "e int, f int, sure boolean, s double")
    text = rows.select(link_text(F.col("e"), F.col("f"), F.col("sure"), F.col("s")).alias("t")).collect()
    assert [r.t for r in text] == ["2-1", "2-1-P", "2-1-0.5"]
    states = spark.createDataFrame([("SURE",), ("POSS",), ("OFF",)], "s string")
    assert states.filter(is_sure(F.col("s"))).count() == 1
    assert states.filter(is_possible(F.col("s"))).count() == 2


def test_session_helpers(spark):
    with session_conf(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_encoding_keeps_pairs_without_words(spark):
    bitext = spark.createDataFrame(
        [(1, ["a"], ["b"]), (2, [], []), (3, None, ["a"]), (3, ["b"], [])],
        "sid long, src array<string>, tgt array<string>")
    vocab = spark.createDataFrame([("a", 1)], "word string, id long")
    rows = sorted((r.sid, r.src, r.tgt) for r in encode_bitext(bitext, vocab).collect())
    assert rows == [(1, [1], [-1]), (2, [], []), (3, [], [1]), (3, [-1], [])]


def test_upsert_without_versions_is_a_hash_aggregation(spark):
    base = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 2, 9)], "e int, f int, n long")
    updates = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 2, None), (3, 3, 4)], "e int, f int, n long")
    out = C.upsert_counts(base, updates)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.e, r.f): r.n for r in out.collect()} == {(1, 1): 3, (1, 2): 7, (2, 2): None, (3, 3): 4}


def test_encoding_beyond_a_broadcast_exchanges_no_tokens(spark):
    """By blocks and by broadcast the lines are the same, repeated and missing line numbers too."""
    from tandem.sinks.text import encoded_lines

    rows = [(1, "<s snum=1> a b a </s>"), (2, ""), (3, "b  c "), (3, "x"), (4, None), (None, "a"), (None, "c b"), (5, "unknown a"), (6, " ")]
    lines = spark.createDataFrame(rows, "line long, value string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("x", 4), ("", 5)], "word string, id long")
    near, far = (encoded_lines(lines, vocab, broadcast_limit=limit) for limit in (None, 1))
    found = [sorted(((r.line is None, r.line, r.encoded) for r in x.collect()), key=str) for x in (near, far)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert (False, 3, "2 4 5 3 ") in found[1] and (True, None, " ") in found[1]
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "pos" not in " ".join(x for x in plan.splitlines() if "Exchange" in x) and "posexplode" not in plan
    ids = [sorted(((r.line, r.ids) for r in encode_lines(lines, F.split("value", " "), vocab, broadcast_limit=limit).collect()), key=str)
           for limit in (None, 1)]
    assert ids[0] == ids[1]


def test_release_collects_garbage_now_and_then(monkeypatch):
    """Files of a shuffle that nobody holds go when asked, not only when the driver's memory runs short."""
    from types import SimpleNamespace

    from tandem import session

    asked = []
    jvm = SimpleNamespace(System=SimpleNamespace(gc=lambda: asked.append(1)))
    monkeypatch.setattr(session, "_released", [float("-inf")])
    for _ in range(3):
        session.release(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)))
    assert len(asked) == 1


@pytest.mark.parametrize("words,value", [("string", "bigint"), ("int", "double")])
def test_cells_move_as_numbers_by_source_word(spark, words, value):
    """Sums, shares, lookups and overwriting as Spark's own operators have them, null words, nulls, NaN and repeated
    cells included; no exchange of rows of words (F11, F17, F19, F20)."""
    rng = random.Random(4)

    def some(n):
        odd = [None, 0, 3, 7, 12] + ([float("nan"), -2.5] if value == "double" else [-4, 1 << 40])
        rows = [(rng.choice([None, 1, 2, 3, 400]), rng.choice([None, *range(9)]), rng.choice(odd)) for _ in range(n)]
        if value == "double":
            rows = [(e, f, None if x is None else float(x)) for e, f, x in rows]
        return spark.createDataFrame(rows, f"e int, f int, n {value}").select(
            F.col("e").cast(words).alias("e"), F.col("f").cast(words).alias("f"), "n").repartition(3)

    a, b = some(70).persist(), some(40).persist()
    keys, both = ["e", "f"], a.unionByName(b)
    sums = a.groupBy("e").agg(F.sum("n").alias("s"))
    old_new = a.withColumn("new", F.lit(False)).unionByName(b.withColumn("new", F.lit(True)))
    wanted = {
        "sum": (C.merge_counts(a, b), both.groupBy(*keys).agg(F.sum("n").alias("n"))),
        "share": (C.normalize_rows(a), a.join(sums, "e").select(*keys, F.try_divide(F.col("n").cast("double"), F.col("s").cast("double")).alias("p"))),
        "look": (C.lookup_cells(a.select(*keys), b, "n"), a.select(*keys).join(b, keys, "left").select(*keys, F.coalesce("n", F.lit(0.0)).alias("n"))),
        "last": (C.upsert_counts(a, b), old_new.groupBy(*keys).agg(
            F.max("new").alias("any"), F.max(F.when(F.col("new"), F.col("n"))).alias("u"), F.max(F.when(~F.col("new"), F.col("n"))).alias("o")).select(
            *keys, F.when(F.col("any"), F.col("u")).otherwise(F.col("o")).alias("n"))),
    }
    for name, (got, want) in wanted.items():
        assert got.dtypes == want.dtypes, name
        found, meant = (sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows.collect()) for rows in (got, want))
        assert found == meant, name
        exchanges = re.findall(r"Exchange hashpartitioning\(([^#]*)#", got._jdf.queryExecution().executedPlan().toString())
        assert set(exchanges) == {"part"}, name


def test_most_likely_words_move_as_numbers(spark):
    """The first of every word as a window has them: null first among ties, NaN first of all, null last (F1)."""
    from pyspark.sql import Window

    from tandem.operators.em import top_translations

    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), f, rng.choice([None, float("nan"), 0.5, 0.5, 0.25, -1.0])) for f in [None, "\ue000", "\U0001f600", *map(str, range(12))]
            for _ in range(1)] + [("c", str(i), 0.1 * (i % 3)) for i in range(9)]
    table = spark.createDataFrame(rows, "e string, f string, p double").repartition(3)
    best = Window.partitionBy("e").orderBy(F.desc("p"), "f")
    want = table.withColumn("rank", F.row_number().over(best)).filter("rank <= 3")
    got = top_translations(table, 3)
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_packed_cells_are_the_cells_again(monkeypatch):
    """However many cells a message has, a part's arrays give the rows back."""
    import numpy as np
    import pyarrow as pa

    from tandem.operators import cells

    monkeypatch.setattr(cells, "PACKED_CELLS", 5)
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice([None, 1, 300, -70_000])) for _ in range(23)]
    schema = pa.schema([("e", pa.string()), ("f", pa.string()), ("n", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip("efn", r)) for r in rows[a:a + 3]], schema) for a in range(0, 23, 3)]
    made = sorted(cells._packed(iter(batches), [8, 3], ["n"]), key=lambda x: x.column("part")[0].as_py())
    parts = list(cells._parts(iter(made), ["n"]))
    found = [tuple(r.values()) for p in parts for b in p.rows(np.arange(len(p.e)), n=(p.values["n"], p.there["n"])) for r in b.to_pylist()]
    assert sorted(found, key=repr) == sorted(rows, key=repr) and len(parts) <= 2 < len(made)
