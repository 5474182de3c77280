"""Shards of near-equal bytes, cut by a k-d tree over metadata.

Each distinct text is a point: length, source, language and smallest id, all
scaled to 0..1 over the table. A node is cut at the weighted
median of its widest dimension, until leaves have at most 1/100 of a shard's bytes
or one text. The cut is found by histograms of the key's next bits, one aggregation
for all nodes of a level, of which the driver sees a row a node; nodes of few texts
are finished inside a task. Ties in a dimension are ordered by a hash of the text.
Leaves are dealt to the shards in runs along the tree, but for the largest and the
smallest, which keep the shards even.

Equal texts share a shard. Only a group of copies with more bytes than a shard and
than any one text is divided, by a hash of the id, and stays out of the tree.

Defined cases: null text has size 16 like an empty one, and is equal to it; a
null in another column is a value of its own (0 for numbers); rows repeated are
rows; with fewer texts than shards some shards stay empty; an empty table gives
no rows. Columns other than doc_id, text, lang, source are not read.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm.common import ID, body, join_groups, stored
from tandem.session import shuffle_partitions

VALUE_BITS, TIE_BITS, STEP = 20, 24, 11
KEY_BITS = VALUE_BITS + TIE_BITS
DIMENSIONS = ("chars", "source", "lang", "first_id")
LARGE_PART, RUN_PART = 100, 10
IN_TASK = 4096
BROADCAST_ROWS = 200_000
FIXED_BYTES = 16


def metadata(docs: DataFrame) -> DataFrame:
    raw = body().cast("binary")
    label = lambda c: (F.abs(F.xxhash64(F.col(c).cast("string"))) % 4096).cast("double")
    have = set(docs.columns)
    return docs.select(
        F.col(ID).cast("long").alias(ID),
        (F.octet_length(raw) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest"),
        F.log1p(F.length(body())).alias("chars"),
        *[(label(c) if c in have else F.lit(0.0)).alias(c) for c in ("source", "lang")])


def texts(rows: DataFrame) -> DataFrame:
    """One row a distinct text; copies may differ in source, so the least counts."""
    return rows.groupBy("digest").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(c) for c in ("chars", "source", "lang")],
        F.coalesce(F.min(ID), F.lit(0)).cast("double").alias("first_id"))


def place_large(large: list[tuple[str, int]], shards: int, target: float, filled: list[float] | None = None):
    """Pieces (digest, from, to, shard) of the hash range 0..1, and bytes by shard."""
    filled, pieces = filled or [0.0] * shards, []
    for digest, size in sorted(large, key=lambda g: (-g[1], g[0])):
        start, left = 0.0, float(size)
        while start < 1.0:
            shard = min(range(shards), key=lambda s: (filled[s], s))
            room = target - filled[shard]
            whole = start == 0.0 and left <= max(room, target / LARGE_PART)
            take = left if whole or room <= 0 or left <= room else room
            end = 1.0 if take >= left else start + take / size
            pieces.append((digest, start, end, shard))
            filled[shard] += take
            start, left = end, left - take
    return pieces, filled


def scaled_keys(points: DataFrame) -> list[Column]:
    """A dimension as VALUE_BITS of its place between the ends, then tie bits."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in DIMENSIONS
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.col("tie").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    top = (1 << VALUE_BITS) - 1
    keys = []
    for c in DIMENSIONS:
        lo, hi = ends[f"lo_{c}"] or 0.0, ends[f"hi_{c}"] or 0.0
        place = (F.col(c) - lo) / (hi - lo) * top if hi > lo else F.lit(0.0)
        keys.append((F.floor(place).cast("long") * (1 << TIE_BITS) + tie).alias(f"k_{c}"))
    return keys


def next_bits(points: DataFrame, nodes: DataFrame, shift: int) -> DataFrame:
    """``nodes`` with STEP more bits of each cut: the cell in which half the bytes are reached.

    ``rest`` is the bytes of the node less twice those left of the cells chosen so far.
    """
    key = F.element_at(F.array(*[f"k_{c}" for c in DIMENSIONS]), F.col("dim") + 1)
    before = W.partitionBy("path").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return (points.join(F.broadcast(nodes), "path")
            .filter(F.shiftright(key, shift + STEP) == F.col("cut"))
            .groupBy("path", "dim", "rest", F.shiftright(key, shift).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"))
            .withColumn("left", 2 * F.coalesce(F.sum("bytes").over(before), F.lit(0)))
            .filter((F.col("left") <= F.col("rest")) & (F.col("rest") < F.col("left") + 2 * F.col("bytes")))
            .select("path", "dim", (F.col("rest") - F.col("left")).alias("rest"), F.col("cell").alias("cut"),
                    F.col("bytes").alias("here")))


def split(points: DataFrame, nodes: list[tuple[str, int, int]]) -> DataFrame:
    """Points of the nodes (path, dimension, bytes), cut at weighted medians: a digit more of path."""
    spark = points.sparkSession
    kind = "path string, dim int, rest long, cut long, here long"
    found = [(path, dim, size, 0, 0) for path, dim, size in nodes]
    for shift in range(KEY_BITS - STEP, -1, -STEP):
        table = spark.createDataFrame(found, kind).drop("here")
        found = [tuple(r) for r in next_bits(points, table, shift).collect()]
    # nearer with the last key on the left: its right neighbour is the cut
    cuts = [(path, dim, cut + (rest > here)) for path, dim, rest, cut, here in found]
    key = F.element_at(F.array(*[f"k_{c}" for c in DIMENSIONS]), F.col("dim") + 1)
    side = F.when(key < F.col("cut"), F.lit("0")).otherwise(F.lit("1"))
    return (points.join(F.broadcast(spark.createDataFrame(cuts, "path string, dim int, cut long")), "path")
            .withColumn("path", F.concat("path", side)).drop("dim", "cut"))


def split_here(keys: np.ndarray, sizes: np.ndarray, limit: float) -> list[str]:
    """The path of each point below a node that one task holds, by the same cuts."""
    paths, todo = [""] * len(sizes), [(np.arange(len(sizes)), "")]
    while todo:
        own, path = todo.pop()
        total, widths = int(sizes[own].sum()), np.ptp(keys[own], axis=0)
        if total <= limit or not widths.any():
            for i in own:
                paths[i] = path
            continue
        column = keys[own, int(np.argmax(widths))]
        order = np.argsort(column, kind="stable")
        found, first = np.unique(column[order], return_index=True)
        sums = np.add.reduceat(sizes[own][order], first)
        ends = 2 * np.cumsum(sums)
        chosen = int(np.searchsorted(ends, total, side="right"))
        rest = total - (int(ends[chosen]) - 2 * int(sums[chosen]))
        left = column < found[chosen + (rest > sums[chosen])]
        todo += [(own[left], path + "0"), (own[~left], path + "1")]
    return paths


def grow_tree(points: DataFrame, limit: float, in_task: int = IN_TASK) -> DataFrame:
    """Points with the ``path`` of their leaf: at most ``limit`` bytes, or one text.

    A level is a few aggregations over all its nodes; the driver has a row a node, of
    which there are fewer than bytes / ``limit`` a level. A node of at most ``in_task``
    texts is finished by one task.
    """
    keys = [f"k_{c}" for c in DIMENSIONS]
    kind = points.withColumn("path", F.lit("")).schema

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        below = split_here(part[keys].to_numpy(np.int64), part["bytes"].to_numpy(np.int64), limit)
        return part.assign(path=part["path"] + pd.Series(below, index=part.index))

    level, done, small = points.withColumn("path", F.lit("")), [], []
    while True:
        nodes = level.groupBy("path").agg(
            F.count(F.lit(1)).alias("texts"), F.sum("bytes").alias("bytes"),
            *[(F.max(k) - F.min(k)).alias(k) for k in keys]).filter(F.col("bytes") > F.lit(limit)).collect()
        cut, whole = [], []
        for r in nodes:
            widths = [r[k] for k in keys]
            if r["texts"] <= in_task:
                whole.append((r["path"],))
            elif any(widths):
                cut.append((r["path"], widths.index(max(widths)), r["bytes"]))
        table = lambda rows: F.broadcast(points.sparkSession.createDataFrame(rows, "path string"))
        if whole:
            small.append(level.join(table(whole), "path").select(*kind.names))
        done.append(level.join(table(whole + [n[:1] for n in cut]), "path", "left_anti").select(*kind.names))
        if not cut:
            break
        level = stored(split(level, cut).select(*kind.names), "level")
    if small:
        done.append(reduce(DataFrame.unionByName, small).groupBy("path").applyInPandas(finish, kind))
    return reduce(DataFrame.unionByName, done)


def place_leaves(leaves: list[tuple[str, int]], divided: list[tuple[str, int]], shards: int, target: float):
    """(path, shard) of the leaves, and the pieces of the groups to divide.

    Leaves above a tenth of a shard go first, largest first to the emptiest shard, and
    divided groups fill up. Then each shard takes a run of leaves in the order of the
    tree; the smallest leaves, a tenth of the bytes, even out what is left.
    """
    by_size = lambda rows: sorted(rows, key=lambda r: (-r[1], r[0]))
    filled, places = [0.0] * shards, []

    def put_on_emptiest(rows: list[tuple[str, int]]) -> None:
        heap = [(size, s) for s, size in enumerate(filled)]
        heapq.heapify(heap)
        for path, size in by_size(rows):
            _, s = heap[0]
            places.append((path, s))
            filled[s] += size
            heapq.heapreplace(heap, (filled[s], s))

    put_on_emptiest([r for r in leaves if r[1] * RUN_PART > target])
    pieces, filled = place_large(divided, shards, target, filled)
    rest = by_size(r for r in leaves if r[1] * RUN_PART <= target)
    bytes_left, held = sum(r[1] for r in rest) / RUN_PART, []
    while rest and bytes_left > 0:
        held.append(rest.pop())
        bytes_left -= held[-1][1]
    caps = [f + max(0.0, target - f) * (1 - 1 / RUN_PART) for f in filled]
    s = 0
    for path, size in sorted(rest):
        while s < shards and filled[s] + size / 2 > caps[s]:
            s += 1
        if s < shards:
            places.append((path, s))
            filled[s] += size
        else:
            held.append((path, size))
    put_on_emptiest(held)
    return places, pieces


def shard(docs: DataFrame, shards: int = 40, in_task: int = IN_TASK) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot (gapless from 0)."""
    rows = stored(metadata(docs), "metadata")
    groups = stored(texts(rows).withColumn("tie", F.xxhash64("digest")), "texts")
    totals = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                        F.coalesce(F.max(F.col("bytes") / F.col("n")), F.lit(0.0)).alias("longest")).first()
    target = totals["bytes"] / shards
    # copies that fit in no shard: fewer such groups than shards
    beyond = F.col("bytes") > F.lit(max(target, totals["longest"]))
    divided = [(r["digest"], r["bytes"]) for r in groups.filter(beyond).select("digest", "bytes").collect()]
    whole = groups.filter(~beyond)
    points = stored(whole.select("digest", "n", "bytes", *scaled_keys(whole)), "points")
    leaves = stored(grow_tree(points, target / LARGE_PART, in_task).select("digest", "n", "bytes", "path"), "leaves")
    places, pieces = place_leaves([(r["path"], r["bytes"]) for r in leaves.groupBy("path").agg(
        F.sum("bytes").alias("bytes")).collect()], divided, shards, target)

    spark = docs.sparkSession
    homes = spark.createDataFrame(places, "path string, shard int")
    homes = F.broadcast(homes) if len(places) <= BROADCAST_ROWS else homes
    table = F.broadcast(spark.createDataFrame(
        pieces, "digest string, start double, end double, shard int"))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("piece"), F.col(ID)), 11) / float(1 << 53)
    in_pieces = (rows.withColumn("spot", spot).join(table, "digest")
                 .filter((F.col("spot") >= F.col("start")) & (F.col("spot") < F.col("end"))))
    in_leaves = join_groups(
        rows.join(table.select("digest").distinct(), "digest", "left_anti"),
        leaves.join(homes, "path").select("digest", "n", "shard"), "digest", "n", totals["n"])
    columns = (ID, "size", "text_crc32", "shard")
    placed = stored(in_pieces.select(*columns).unionByName(in_leaves.select(*columns)), "placed")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Slots: rows are numbered in cells of a shard, cells by their running sum."""
    cells = shuffle_partitions(placed.sparkSession)
    rows = placed.withColumn("cell", F.pmod(F.xxhash64(ID, "text_crc32"), F.lit(cells)))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy(ID, "text_crc32"))
    return (rows.withColumn("place", within - 1).join(starts, ["shard", "cell"])
            .select(ID, "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot")))
