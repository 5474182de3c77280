"""Corpus encoding: files in, vocabulary and encoded files out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import envelope_body, split_spaces
from tandem.operators.joins import lookup_join
from tandem.operators.order import with_global_index
from tandem.operators.vocab import first_seen_vocab, vocab_growth
from tandem.session import TEXT_ROW_BYTES, fits_broadcast, move_folder, remove_path, written
from tandem.sinks.text import encoded_lines, write_encoded_by_file, write_vocab
from tandem.sources.folders import file_names, resolved
from tandem.sources.lines import dataset_of, number_lines, read_lines

# Lines of one file that a line number has room for: 2^41; files: 2^21.
LINE_BITS = 41


def corpus_words(value: str = "value"):
    return split_spaces(envelope_body(F.col(value)))


def encode_corpus(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``word, id`` and encoded lines ``line, encoded`` of numbered lines.

    ``lines`` has ``line`` (a number ordering the lines of all files) and ``value``.
    """
    vocab = first_seen_vocab(lines, corpus_words())
    return vocab, encoded_lines(lines, vocab)


def corpus_growth(lines: DataFrame, file: str = "file") -> DataFrame:
    """Vocabulary size after each file, files in the order of their names or numbers."""
    ranks = with_global_index(lines.select(F.col(file).alias("file")).distinct(), "file", name="_rank")
    ranked = lookup_join(lines.withColumnRenamed(file, "file"), ranks, ["file"])
    tokens = ranked.select("_rank", F.explode(F.array_distinct(corpus_words())).alias("word"))
    growth = vocab_growth(tokens, "_rank").withColumnRenamed("file", "_rank")
    return ranks.join(growth, "_rank").select("file", "n_new", "n_words")


def _places(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """What to scan, and (dataset, place in reading order, number of its path) for each dataset.

    Works on file names alone. A file below two of the paths is read once and has two places.
    """
    numbers: dict[str, list[int]] = {}
    for number, path in enumerate(paths):
        for root in resolved(spark, path):
            numbers.setdefault(root, []).append(number)
    found = []
    for dataset in sorted({dataset_of(name) for name in file_names(spark, paths)}) if paths else []:
        above = dataset
        while above:
            found += [(number, dataset) for number in numbers.get(above, [])]
            above = above.rpartition("/")[0]
    places = [(dataset, place, number) for place, (number, dataset) in enumerate(sorted(found))]
    scans = [path for path in dict.fromkeys(paths)
             if not all(any(root.startswith(f"{other}/") for other in numbers) for root in resolved(spark, path))]
    return scans, places


def read_corpus(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``line, value`` of files read one after the other in the given order, and ``place, file``.

    One scan whatever the number of files: a line's number is its file's place in
    reading order, in the high bits, and its own number in that file.
    """
    scans, places = _places(spark, paths)
    table = spark.createDataFrame(places, "dataset string, place long, file int")
    if fits_broadcast(len(places), TEXT_ROW_BYTES):
        table = F.broadcast(table)
    lines = number_lines(read_lines(spark, scans)).join(table.select("dataset", "place"), "dataset")
    return lines.select((F.shiftleft("place", LINE_BITS) + F.col("line_no")).alias("line"), "value"), table


def encode_files(spark: SparkSession, dictionary: str, paths: list[str]) -> DataFrame:
    """Encode files with one shared vocabulary; writes ``path.out`` and the dictionary.

    All files are read by one scan and written by one job, by file; the folders then
    get their names. Returns the vocabulary size after each file.
    """
    lines, places = read_corpus(spark, paths)
    lines = written(lines, "lines")
    vocab, encoded = encode_corpus(lines)
    encoded = written(encoded, "encoded")  # else the range partitions' sample encodes all once more

    def with_file(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.shiftright("line", LINE_BITS)).join(
            places.select("place", "file"), "place").drop("place")

    staged = f"{dictionary}.files-{uuid.uuid4().hex}"
    write_encoded_by_file(with_file(encoded), staged)
    for number, path in enumerate(paths):
        move_folder(spark, f"{staged}/file={number}", f"{path}.out")
    remove_path(spark, staged)
    write_vocab(vocab, dictionary)
    return corpus_growth(with_file(lines))
