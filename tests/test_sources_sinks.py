import gzip
import os

import pytest

from tandem.functions.text import sgml_id, sgml_words
from tandem.plans.encode import encode_files
from tandem.plans.job import run
from tandem.sinks.text import write_links, write_paired_bitext
from tandem.sources.bitext import (
    accept_pairs, duplicate_ids, empty_sources, id_mismatches, line_count_report, ordered_pairs,
    paired_lines, parse_pairs, pipe_rejects, read_bitext_files, read_paired_bitext,
    read_pipe_bitext, reverse_bitext, side_lines)
from tandem.sources.gold import gold_rejects, read_gold_links
from tandem.sources.lines import number_lines, read_lines, text_lines


def put(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8") as out:
        out.write("".join(line + "\n" for line in lines))
    return str(path)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = put(f"{tmp_path}/big/x.txt", *[f"line {i} é" for i in range(1, 3001)])
    put(f"{tmp_path}/big/y.txt", *[f"line {i} é" for i in range(1, 11)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = number_lines(read_lines(spark, os.path.dirname(path)))
        assert lines.select("file", "block").distinct().count() > 5
        rows = lines.select("dataset", "line_no", "ordinal", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert all(r.value == f"line {r.line_no} é" for r in rows)
    assert sorted(r.ordinal for r in rows) == list(range(1, 3011))


def test_part_files_are_one_dataset_in_part_order(spark, tmp_path):
    put(f"{tmp_path}/d/part-00010-a.txt", "c")
    put(f"{tmp_path}/d/part-00002-b.txt", "a", "b")
    rows = text_lines(spark, f"{tmp_path}/d").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in rows] == [(1, "a"), (2, "b"), (3, "c")]


def test_pipe_bitext(spark, tmp_path):
    path = put(f"{tmp_path}/p.txt", "3 7 9 | 12 4", " 1 | 2 | 3", "1 2", "1  2 | 3", "x | 1", "| 4")
    with pytest.raises(Exception, match="bad pair line 3"):
        read_pipe_bitext(spark, path).collect()
    rows = {r.sid: (r.src, r.tgt) for r in read_pipe_bitext(spark, path, strict=False).collect()}
    assert rows == {1: ([3, 7, 9], [12, 4]), 2: ([1], [2])}
    assert {r.sid for r in pipe_rejects(spark, path).collect()} == {3, 4, 5, 6}
    assert read_pipe_bitext(spark, path, max_per_split=1).count() == 1


def corpus(tmp_path):
    put(f"{tmp_path}/src/a.en", "<s snum=0001> the house </s>", "no id", "<s snum=5> x </s>", "left over")
    put(f"{tmp_path}/src/a.fr", "<s snum=0001> la maison </s>", "sans  id ", "<s snum=6> x </s>")
    put(f"{tmp_path}/src/deep/b.en.gz", "one", "two")
    put(f"{tmp_path}/src/deep/b.fr.gz", "un", "deux")
    put(f"{tmp_path}/src/c.broken", "not read")
    return f"{tmp_path}/src"


def test_paired_bitext(spark, tmp_path):
    root = corpus(tmp_path)
    with pytest.raises(Exception, match="ids differ"):
        read_paired_bitext(spark, root).collect()
    rows = ordered_pairs(read_paired_bitext(spark, root, strict=False)).collect()
    assert [(r.sid, r.src, r.tgt) for r in rows] == [
        (1, ["the", "house"], ["la", "maison"]), (-2, ["no", "id"], ["sans", "id"]),
        (-4, ["one"], ["un"]), (-5, ["two"], ["deux"])]
    assert rows[0].source_file.endswith("/src/a")
    src, tgt = side_lines(spark, root, "en"), side_lines(spark, root, "fr")
    parsed = parse_pairs(paired_lines(src, tgt))
    assert [(r.line_no, r.src_id, r.tgt_id) for r in id_mismatches(parsed).collect()] == [(3, 5, 6)]
    assert [(r.n_src, r.n_tgt) for r in line_count_report(src, tgt).collect()] == [(4, 3)]


def test_offset_limit_and_filter_count_accepted_pairs(spark, tmp_path):
    root = corpus(tmp_path)
    some = read_paired_bitext(spark, root, where="size(src) = 1", offset=1, limit=1, strict=False)
    assert [r.sid for r in some.collect()] == [-5]
    both = read_paired_bitext(spark, [root, root], strict=False)
    assert both.count() == 8 and empty_sources(both, 3).count() == 1
    assert accept_pairs(both).count() == 8


def test_named_files(spark, tmp_path):
    root = corpus(tmp_path)
    rows = read_bitext_files(spark, f"{root}/deep/b.en.gz", f"{root}/deep/b.fr.gz", limit=1).collect()
    assert [(r.sid, r.src, r.tgt) for r in rows] == [(-1, ["one"], ["un"])]


def test_a_folder_named_like_a_side_is_not_one(spark, tmp_path):
    put(f"{tmp_path}/news.en/a.en", "one")
    put(f"{tmp_path}/news.en/a.fr", "un")
    assert [(r.src, r.tgt) for r in read_paired_bitext(spark, f"{tmp_path}").collect()] == [(["one"], ["un"])]


def test_a_word_glued_to_the_tag_is_kept(spark):
    lines = spark.createDataFrame([("<s snum=1>hello world </s>",), ("<s snum=2> x </s>",)], "value string")
    rows = lines.select(sgml_id(lines.value).alias("i"), sgml_words(lines.value).alias("w")).collect()
    assert [(r.i, r.w) for r in rows] == [(-1, ["snum=1>hello", "world"]), (2, ["x"])]


def test_missing_source_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_paired_bitext(spark, f"{tmp_path}/nowhere").count()


def test_duplicate_ids_and_reverse(spark):
    bitext = spark.createDataFrame([(1, ["a"], ["b"]), (1, ["c"], ["d"]), (2, ["e"], ["f"])],
                                   "sid long, src array<string>, tgt array<string>")
    assert [(r.sid, r.n) for r in duplicate_ids(bitext).collect()] == [(1, 2)]
    assert reverse_bitext(reverse_bitext(bitext)).exceptAll(bitext).count() == 0


def test_gold(spark, tmp_path):
    path = put(f"{tmp_path}/test.wa", "0001 1 2 S ", "0001 1 2 P", "0002 3 1 X", "0002 0 1 S")
    rows = {tuple(r) for r in read_gold_links(spark, path).collect()}
    assert rows == {(1, 0, 1, True), (2, 2, 0, False)}
    bad = put(f"{tmp_path}/bad.wa", "1 2 3", "1 2 3 S")
    with pytest.raises(Exception, match="bad alignment line"):
        read_gold_links(spark, bad).collect()
    assert read_gold_links(spark, bad, strict=False).count() == 1
    assert gold_rejects(spark, bad).count() == 1


def test_encode_files(spark, tmp_path):
    first = put(f"{tmp_path}/e/a.en", "<s snum=0001> the house </s>", "the  big", "")
    second = put(f"{tmp_path}/e/a.fr", "la house")
    growth = encode_files(spark, f"{tmp_path}/dict", [first, second]).orderBy("file").collect()
    assert [(r.file, r.n_words) for r in growth] == [(0, 4), (1, 5)]
    encoded = [r.value for r in text_lines(spark, f"{first}.out").orderBy("line_no").collect()]
    assert encoded == ["<s snum=0001> 1 2  </s>", "1 3 4 ", "3 "]
    vocab = {r.value for r in spark.read.text(f"{tmp_path}/dict").collect()}
    assert vocab == {"the 1", "house 2", " 3", "big 4", "la 5"}


def test_whole_job_on_files(spark, tmp_path):
    train = put(f"{tmp_path}/train/p.txt", "1 2 | 3 4", "1 | 3", "2 | 4", "5 | 6")
    put(f"{tmp_path}/test/t.en", "<s snum=1> 1 2 </s>", "<s snum=2> 5 </s>")
    put(f"{tmp_path}/test/t.fr", "<s snum=1> 3 4 </s>", "<s snum=2> 6 </s>")
    gold = put(f"{tmp_path}/test.wa", "1 1 1 S", "1 2 2 S", "2 1 1 P")
    out = run(spark, train, f"{tmp_path}/test", gold, rounds=5, print_grid=True)
    row = out.metrics.first()
    assert (row.precision, row.recall, row.aer) == (1.0, 1.0, 0.0)
    assert out.grid.count() > 0 and out.unscored.count() == 0
    write_links(out.links, f"{tmp_path}/links")
    assert {r.value for r in spark.read.text(f"{tmp_path}/links").collect()} == {"1\t0-0 1-1", "2\t0-0"}


def test_paired_training_with_limit(spark, tmp_path):
    bitext = spark.createDataFrame([(1, ["1"], ["3"]), (2, ["2"], ["4"])],
                                   "sid long, src array<string>, tgt array<string>")
    write_paired_bitext(bitext, f"{tmp_path}/train/x", "en", "fr")
    write_paired_bitext(bitext, f"{tmp_path}/test/x", "en", "fr", tagged=True)
    gold = put(f"{tmp_path}/test.wa", "1 1 1 S")
    out = run(spark, f"{tmp_path}/train", f"{tmp_path}/test", gold, "paired", max_train=1, rounds=1)
    assert {(r.e, r.f) for r in out.table.collect()} == {(0, 3), (1, 3)}
    with pytest.raises(ValueError):
        run(spark, f"{tmp_path}/train", f"{tmp_path}/test", gold, "other")
