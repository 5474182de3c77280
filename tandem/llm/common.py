"""What the operators of this package share: reading, storing, grouping, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import cut_lineage, scratch_path, shuffle_partitions

ID, TEXT = "doc_id", "text"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(column: str = TEXT) -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what an operator reads, whatever other columns there are."""
    return docs.select(F.col(ID).cast("long").alias(ID), body().alias(TEXT))


def crc_of_id() -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(ID).cast("string"), F.lit("")).cast("binary"))


def packed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Whole rows as the one column ``row``, and ``more``: no name of theirs can clash.

    ``rows.select("row.*")`` gives the rows back.
    """
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), *more)


def quoted(name: str) -> Column:
    """The column of just this name, also if the name holds dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_of_row(docs: DataFrame) -> Column:
    """A hash over the columns that can be hashed, which orders rows that are alike otherwise."""
    return F.xxhash64(*[quoted(c) for c, kind in docs.dtypes if "map" not in kind and kind != "variant"])


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Cuts lineage like a checkpoint, but column-wise and compressed, so later
    passes read only the columns they need and survive a lost executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to the table of their groups, balanced under hot groups.

    ``groups`` has one row a ``key`` and the number of its rows in ``size``. A
    group with over 1/P of all ``total`` rows is hot: there are fewer than P of
    these, so they are broadcast, and only rows of small groups are shuffled.
    """
    parts = shuffle_partitions(rows.sparkSession)
    hot = cut_lineage(groups.filter(F.col(size) * parts > F.lit(total)))
    hot_keys = F.broadcast(hot.select(key))
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(hot_keys, key, "left_anti").join(
        groups.join(hot_keys, key, "left_anti"), key)
    return hot_rows.unionByName(cold_rows)


def task_count(docs: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Tasks for a shuffle of whole texts: the session's number, more for more data.

    ``bytes_each`` of stored input, by the optimizer's estimate, go to one task.
    """
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(max(shuffle_partitions(docs.sparkSession), -(-int(str(size)) // bytes_each)), 100_000)


def ordered_buckets(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with ``bucket``, rising with doc_id; and how many.

    Bounds are approximate quantiles of the ids (at most ``buckets`` numbers); a
    null id sorts first. Rows of one id stay in one bucket.
    """
    bounds = docs.agg(F.percentile_approx(
        ID, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 20 * buckets)
        .alias("q")).first()["q"] if buckets > 1 else []
    bounds = sorted(set(bounds or []))
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(cuts, lambda c: c <= F.coalesce(F.col(ID), F.lit(-(1 << 63)))))
    return docs.withColumn("bucket", bucket.cast("int")), len(bounds) + 1
