"""Source folders: their files, one frame per source and base, and what is wrong with them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.constants import SRC_EXT, TGT_EXT
from tandem.session import TEXT_ROW_BYTES, fits_broadcast
from tandem.sources.bitext import read_bitext_files, read_paired_bitext, side_pattern


def _plain(name: str) -> str:
    """One form of a local name: the file column writes ``file:/``, listings may write ``file:///``."""
    return re.sub("^file:///", "file:/", name)


def resolved(spark: SparkSession, path: str) -> list[str]:
    """Full names of what a path or glob names, as the readers' file column writes them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return [_plain(status.getPath().toUri().toString()) for status in found or []]


def file_names(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Names of all files below ``paths``, empty ones too; no file is opened."""
    read = spark.read.option("recursiveFileLookup", "true").text(paths)
    return sorted(_plain(name) for name in read.inputFiles())


class SourceFrames(Mapping):
    """A frame for each (number of the source, base) that has both sides.

    ``base`` is the name below the source folder without extension, escaped like a URI as
    in the readers' file column. Folders are
    listed at the first use; a frame is made when asked for and reads its own two
    files only. ``lone`` has the (source, base, extension) that lack a partner.
    """

    def __init__(self, spark: SparkSession, sources: str | list[str], src_ext: str = SRC_EXT,
                 tgt_ext: str = TGT_EXT, strict: bool = True):
        self.spark, self.strict = spark, strict
        self.sources = [sources] if isinstance(sources, str) else list(sources)
        self.sides = src_ext, tgt_ext

    @cached_property
    def _listed(self) -> dict[tuple[int, str], dict[str, str]]:
        listed: dict[tuple[int, str], dict[str, str]] = {}
        for number, source in enumerate(self.sources):
            for root in resolved(self.spark, source):
                for name in file_names(self.spark, source):
                    for ext in self.sides:
                        match = re.match(side_pattern(ext), name)
                        if match and name.startswith(f"{root}/"):
                            base = match[1][len(root) + 1:]
                            listed.setdefault((number, base), {})[ext] = re.sub("/part-[^/]*$", "", name)
        return dict(sorted(listed.items()))

    @property
    def lone(self) -> list[tuple[int, str, str]]:
        return [(*key, ext) for key, found in self._listed.items() if len(found) == 1 for ext in found]

    @property
    def missing(self) -> list[int]:
        """Numbers of the sources that do not exist."""
        return [n for n, source in enumerate(self.sources) if not resolved(self.spark, source)]

    def __getitem__(self, key: tuple[int, str]) -> DataFrame:
        found = self._listed[key]
        if len(found) < 2:
            raise KeyError(key)
        src, tgt = (self._path(found[ext]) for ext in self.sides)
        return read_bitext_files(self.spark, src, tgt, strict=self.strict)

    def _path(self, name: str) -> str:
        """The name without its URI escapes, as the readers take it."""
        uri = self.spark.sparkContext._jvm.java.net.URI(name)
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri).toString()

    def __iter__(self) -> Iterator[tuple[int, str]]:
        return (key for key, found in self._listed.items() if len(found) == 2)

    def __len__(self) -> int:
        return sum(1 for _ in self)


def source_health(spark: SparkSession, sources: str | list[str], src_ext: str = SRC_EXT,
                  tgt_ext: str = TGT_EXT) -> DataFrame:
    """What each source and base gave: ``source_idx, base, n_pairs, state``.

    States: ``ok``; ``no pairs`` (both files, no pair read); ``no partner`` (one side
    only); ``no files`` and ``missing``, with an empty base, for a whole folder. The
    listing is a row per file; pairs are counted where they are read.
    """
    frames = SourceFrames(spark, sources, src_ext, tgt_ext)
    missing = set(frames.missing)
    rows = [(*key, "ok") for key in frames] + [(n, base, "no partner") for n, base, _ in frames.lone]
    seen = {row[0] for row in rows}
    rows += [(n, "", "missing" if n in missing else "no files")
             for n in range(len(frames.sources)) if n not in seen]
    listed = spark.createDataFrame(rows, "source_idx int, base string, state string")
    there = [n for n in range(len(frames.sources)) if n not in missing]
    if not there:
        return listed.select("source_idx", "base", F.lit(0).cast("long").alias("n_pairs"), "state")
    # a source's own number and the length of its full name, by its number among those there
    roots = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(len(root)).alias("skip"))
                      for n in there for root in resolved(spark, frames.sources[n])[:1]])
    pairs = read_paired_bitext(spark, [frames.sources[n] for n in there], src_ext, tgt_ext, strict=False)
    counted = (
        pairs.groupBy("source_idx", "source_file").agg(F.count(F.lit(1)).alias("n_pairs"))
        .withColumn("_root", F.get(roots, F.col("source_idx")))
        .select(F.col("_root.n").alias("source_idx"), "n_pairs",
                F.expr("substring(source_file, _root.skip + 2)").alias("base"))
    )
    if fits_broadcast(len(rows), TEXT_ROW_BYTES):
        listed = F.broadcast(listed)
    return counted.join(listed, ["source_idx", "base"], "right").select(
        "source_idx", "base", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        F.when((F.col("state") == "ok") & F.col("n_pairs").isNull(), "no pairs").otherwise(F.col("state")).alias("state"))
