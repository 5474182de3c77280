"""Exact duplicates by a persistent digest index, DataFrame operations only.

The index is a table of one row a text: SHA-256 digest and the id of the row
that stays, bucketed and sorted by digest. New rows are grouped by digest (with
partial sums, so a hot digest costs a row a task), sort-merge anti-joined to the
index and appended. Texts never enter a shuffle, digests do.

Defined cases: a null text counts as empty, and all empty texts are equal. Of
equal texts in one batch the largest doc_id stays, null being the smallest; a
text that the index already has keeps the id it has there. Rows repeated with
one doc_id and one text are one document: ``mark`` marks them alike and
``keep`` leaves one of them, the smallest by a hash of its columns. An empty
table gives an empty result. Other columns are ignored by ``mark`` and returned
as they are by ``keep``, whatever their names.

The index outlives its session: beside the files lies their layout, from which a
session that does not know the table yet registers it again, before anything is added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm.common import ID, body, hash_of_row, join_groups, packed_rows, stored
from tandem.session import scratch_path, shuffle_partitions

SCHEMA = "digest string, keep_id long"


def digest_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ID).cast("long").alias(ID),
                       F.sha2(body().cast("binary"), 256).alias("digest"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class DigestIndex:
    """The table ``name``; made on the first append, with ``buckets`` buckets.

    ``path`` puts its files outside the warehouse; files that are there already are
    the index, whatever session wrote them, and keep their number of buckets. A
    folder that holds anything else is refused. Appends by several writers at once
    need a lock around ``add``.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None,
                 path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or shuffle_partitions(spark)
        if path and not spark.catalog.tableExists(name) and folder_exists(spark, path):
            self.reopen()

    @property
    def layout(self) -> str:
        return f"{self.path}_layout"

    def reopen(self) -> None:
        """Register the files of an earlier session as the table."""
        if not folder_exists(self.spark, self.layout):
            raise ValueError(f"{self.path} is there already and is no digest index")
        held = self.spark.read.schema("buckets int, columns string").json(self.layout).first()
        if held is None or held["columns"] != SCHEMA:
            raise ValueError(f"the digest index in {self.path} has other columns than {SCHEMA}")
        self.buckets = held["buckets"]
        self.spark.sql(
            f"CREATE TABLE {self.name} ({SCHEMA.replace('string', 'STRING').replace('long', 'BIGINT')}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], SCHEMA)

    def add(self, rows: DataFrame) -> None:
        """Append the texts of ``rows`` (doc_id, digest) that the index lacks."""
        new = rows.groupBy("digest").agg(F.max(ID).alias("keep_id"))
        known = self.spark.catalog.tableExists(self.name)
        if known:
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        writer = new.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.path:
            if not known:  # before any file, so that files are never without their layout
                self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(SCHEMA).alias("columns")) \
                    .write.mode("overwrite").json(self.layout)
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.name)

    def forget(self) -> None:
        """Take the table out of the catalog; files under ``path`` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def index_newest_first(rows: DataFrame) -> DataFrame:
    """A fresh index over ``rows``, fed in two batches with the larger ids first.

    An index keeps what came first, so this order leaves the largest id of all.
    """
    spark = rows.sparkSession
    # shared folder, as the result is read from the files after this returns
    index = DigestIndex(spark, f"tandem_digests_{uuid.uuid4().hex}", path=scratch_path(spark, "index"))
    ends = rows.agg(F.min(ID).alias("lo"), F.max(ID).alias("hi")).first()
    if ends["lo"] is not None:
        half = ends["lo"] + (ends["hi"] - ends["lo"] + 1) // 2
        newer = F.coalesce(F.col(ID) >= F.lit(half), F.lit(False))
        index.add(rows.filter(newer))
        index.add(rows.filter(~newer))
    else:
        index.add(rows)
    kept = index.read()
    files = spark.read.schema(kept.schema).parquet(index.path)
    index.forget()
    return files


def mark(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(digest_rows(docs), "digests")
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(index_newest_first(rows).hint("merge").join(sizes, "digest"), "groups")
    return join_groups(rows, groups, "digest", "group_size", rows.count()).select(
        ID, "keep_id", "group_size", F.col(ID).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies; all columns of the rows that stay.

    Rows meet the index on digest and id together, a pair that repeats only if
    the row itself does, so a hot text does not make a hot key.
    """
    kept = index_newest_first(stored(digest_rows(docs), "digests"))

    # ids are made non-null for the join, a flag keeps null apart from its stand-in
    def key(column: str) -> list[Column]:
        return [F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("id"), F.col(column).isNull().alias("none")]

    rows = packed_rows(docs, F.sha2(body().cast("binary"), 256).alias("digest"), *key(ID),
                       hash_of_row(docs).alias("order"))
    first = F.row_number().over(W.partitionBy("digest", "id", "none").orderBy("order"))
    return (rows.join(kept.select("digest", *key("keep_id")), ["digest", "id", "none"], "left_semi")
            .withColumn("at", first).filter("at = 1").select("row.*"))
