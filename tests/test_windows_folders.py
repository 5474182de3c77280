import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import order as O
from tandem.plans.encode import encode_files
from tandem.sources.bitext import read_paired_bitext
from tandem.sources.folders import SourceFrames, source_health
from tandem.sources.lines import text_lines


def put(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if path.endswith(".gz") else open)(path, "wt") as f:
        f.writelines(f"{line}\n" for line in lines)
    return path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_sample(monkeypatch):
    monkeypatch.setattr(O, "_SAMPLE", 40)


WINDOWS = [(0, 7), (30, 45), (390, 50), (0, None), (123, None), (400, 3), (5, 0), (60, 2), (77, 300)]


@pytest.mark.parametrize("offset,limit", WINDOWS)
def test_window_against_a_sorted_list(spark, small_sample, offset, limit):
    rng = random.Random(offset)
    rows = [(rng.choice(["a", "b", None]), i if i % 9 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, id int").repartition(3)
    least = lambda x, low: low if x is None else x
    order = sorted((least(k, ""), least(n, -1)) for k, n, _ in rows)
    got = O.skip_take(df, "k", "n", offset=offset, limit=limit).collect()
    assert sorted((least(r.k, ""), least(r.n, -1)) for r in got) == order[
        offset:None if limit is None else offset + limit]
    assert len({r.id for r in got}) == len(got)


def test_rank_of_a_hot_key(spark, small_sample):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 500).otherwise(F.col("id")).alias("x"))
    order = sorted(r.x for r in df.collect())
    for rank in (1, 100, 167, 168, 1500, 2167, 2168, 2999, 3000):
        row, below, same = O.order_statistic(df, "x", rank=rank)
        assert (row.x, below, same) == (order[rank - 1], order.index(row.x), order.count(row.x))
    assert O.order_statistic(df, "x", rank=3001) is None
    assert O.order_statistic(df.limit(0), "x", rank=1) is None


def test_a_window_is_a_filter(spark, small_sample, tmp_path):
    spark.range(2000).write.parquet(f"{tmp_path}/t")
    window = O.skip_take(spark.read.parquet(f"{tmp_path}/t"), "id", offset=700, limit=200)
    assert sorted(r.id for r in window.collect()) == list(range(700, 900))
    plan = plan_of(window)
    assert "Sort" not in plan and "Exchange" not in plan and "ExistingRDD" not in plan
    assert "GreaterThanOrEqual(id,700)" in plan and "LessThanOrEqual(id,899)" in plan


def three_sources(tmp_path):
    put(f"{tmp_path}/s0/a.en", "one", "two")
    put(f"{tmp_path}/s0/a.fr", "un", "deux")
    put(f"{tmp_path}/s0/deep/b.en.gz", "three")
    put(f"{tmp_path}/s0/deep/b.fr.gz", "trois")
    put(f"{tmp_path}/s0/lone.en", "four")
    put(f"{tmp_path}/s1/with blank/c.en/part-00000", "five")
    put(f"{tmp_path}/s1/with blank/c.en/part-00001", "six")
    put(f"{tmp_path}/s1/with blank/c.fr", "cinq", "six", "sept")
    put(f"{tmp_path}/s1/hollow.en")
    put(f"{tmp_path}/s1/hollow.fr")
    put(f"{tmp_path}/s2/notes.txt", "nothing")
    return [f"{tmp_path}/s{n}" for n in range(4)]


def test_a_frame_for_each_source_and_base(spark, tmp_path):
    roots = three_sources(tmp_path)
    frames = SourceFrames(spark, roots[:3])
    assert list(frames) == [(0, "a"), (0, "deep/b"), (1, "hollow"), (1, "with%20blank/c")] and len(frames) == 4
    assert frames.lone == [(0, "lone", "en")] and frames.missing == []
    one = frames[0, "deep/b"]
    assert {os.path.basename(name) for name in one.inputFiles()} == {"b.en.gz", "b.fr.gz"}
    assert [(r.src, r.tgt) for r in one.collect()] == [(["three"], ["trois"])]
    assert sorted((r.src[0], r.tgt[0]) for r in frames[1, "with%20blank/c"].collect()) == [("five", "cinq"), ("six", "six")]
    assert frames[1, "hollow"].count() == 0
    for key in ((0, "lone"), (2, "notes"), (7, "a")):
        with pytest.raises(KeyError):
            frames[key]


def test_what_is_wrong_with_sources(spark, tmp_path):
    rows = source_health(spark, three_sources(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "a", 2, "ok"), (0, "deep/b", 1, "ok"), (0, "lone", 0, "no partner"), (1, "hollow", 0, "no pairs"),
        (1, "with%20blank/c", 2, "ok"), (2, "", 0, "no files"), (3, "", 0, "missing")]
    assert [tuple(r) for r in source_health(spark, f"{tmp_path}/s9").collect()] == [(0, "", 0, "missing")]


def test_a_window_of_pairs_needs_no_sort(spark, tmp_path):
    roots = three_sources(tmp_path)[:2]
    for offset, limit, want in ((0, 3, [1, 2, 3]), (2, None, [3, 4, 5]), (1, 2, [2, 3]), (9, None, [])):
        some = read_paired_bitext(spark, roots, offset=offset, limit=limit)
        assert sorted(r.pair_no for r in some.collect()) == want
        assert "rangepartitioning" not in plan_of(some)
    odd = read_paired_bitext(spark, roots, where="pair_no % 2 = 1", offset=1, limit=1)
    assert [r.pair_no for r in odd.collect()] == [3]


def jobs(spark, tmp_path, n):
    paths = [put(f"{tmp_path}/{n}/text{k}", f"w{k} same", "same again") for k in range(n)]
    spark.sparkContext.setJobGroup(f"encode {n}", "")
    encode_files(spark, f"{tmp_path}/{n}/dictionary", paths)
    count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"encode {n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return count


def test_as_many_jobs_for_few_files_as_for_many(spark, tmp_path):
    threshold = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    spark.conf.set(threshold, "100")  # else Spark lists many paths by a job of its own
    try:
        assert jobs(spark, tmp_path, 2) == jobs(spark, tmp_path, 50)
    finally:
        spark.conf.unset(threshold)
    lines = text_lines(spark, [f"{tmp_path}/50/text{k}.out" for k in (0, 49)]).collect()
    assert sorted((os.path.basename(r.dataset), r.line_no, r.value) for r in lines) == [
        ("text0.out", 1, "1 2 "), ("text0.out", 2, "2 3 "), ("text49.out", 1, "52 2 "), ("text49.out", 2, "2 3 ")]


def test_encode_a_file_twice_an_empty_one_and_a_folder(spark, tmp_path):
    a, empty = put(f"{tmp_path}/in/a", "x y"), put(f"{tmp_path}/in/empty")
    put(f"{tmp_path}/more/part-00000", "z x")
    growth = encode_files(spark, f"{tmp_path}/dictionary", [f"{tmp_path}/more", empty, a]).collect()
    assert sorted((r.file, r.n_new, r.n_words) for r in growth) == [(0, 2, 2), (2, 1, 3)]
    read = lambda path: [r.value for r in spark.read.text(f"{path}.out").collect()]
    assert (read(f"{tmp_path}/more"), read(a)) == (["1 2 "], ["2 3 "])
    assert os.path.isdir(f"{empty}.out") and read(empty) == []
    with pytest.raises(FileExistsError):
        encode_files(spark, f"{tmp_path}/other", [a])
