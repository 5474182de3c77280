"""Near-duplicates by SimHash and a binary trie self-join.

A fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes
of the text's word shingles. Distinct fingerprints, sorted, are a binary trie: a
node is the range with one prefix. The self-join walks pairs of nodes of equal
depth downwards together, from the pair of the root with itself; a step to unlike
children costs one of the ``BITS`` differing bits allowed, and a pair that costs
more is dropped with all below it. Pairs of nodes with one fingerprint each are
compared at once.

On Spark the walk starts at nodes of at most ``node_size`` fingerprints, found
from counts of 16-bit prefixes: one row a node with its fingerprints (a prefix
that is still larger takes several rows), and one row a pair of nodes whose
prefixes differ in few enough bits. Each such pair is joined by itself in a task
that holds two nodes. A task returns links that connect what it found similar, a
spanning forest rather than all pairs, so dense groups stay linear. Links of all
tasks are contracted to components by rounds of joins. Only prefix counts (at
most 65,536) and pairs of prefixes reach the driver.

Defined cases: null is the empty text; texts without words have fingerprint zero,
which links like any other; fewer words than a shingle are one shingle; equal
texts share a fingerprint; rows of one doc_id are rows of their own; a component's
id is its smallest doc_id, nulls aside, null if it has none else. ``keep`` leaves
the row with that id (of repeated rows the least by a hash of their columns, and
of a component without ids likewise). An empty table gives no rows. ``components``
does not read other columns; ``keep`` returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.llm.common import (
    ID, TEXT, body, hash_of_row, id_and_text, join_groups, packed_rows, stored)
from tandem.session import shuffle_partitions

WORDS, BITS, SEED = 4, 4, 42
PREFIX = 16
NODE_SIZE = 1 << 21
NODES = 16
FRONT = 1 << 16
LEAF = 8


def fingerprint(text: str, words: int = WORDS) -> int:
    """Signed, as Spark holds 64 bits."""
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[words - 1:] - 1 if len(found) >= words else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):  # a long text's shingles in parts
        bits = np.unpackbits(hashes[a:a + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, ``mark`` (a hash of the text) and ``fp``, the fingerprint as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(TEXT)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID), batch.column("mark"), pa.array(found, pa.int64())], [ID, "mark", "fp"])

    return id_and_text(docs).withColumn("mark", F.xxhash64(TEXT)).mapInArrow(
        run, "doc_id long, mark long, fp long")


# --- the trie join of two nodes ----------------------------------------------

class Trie:
    """Levels of the trie over sorted distinct fingerprints, made as they are needed."""

    def __init__(self, values: np.ndarray, padding: int):
        self.values, self.levels, self.below = values, {}, {}
        self.padded = np.concatenate([values, np.full(LEAF, padding, np.uint64)])

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of fingerprints of the nodes of ``depth``."""
        if depth not in self.levels:
            prefix = self.values >> np.uint64(64 - depth) if depth else np.zeros(len(self.values), np.uint64)
            cut = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            starts = np.concatenate([[0], cut]).astype(np.int32)
            self.levels[depth] = starts, np.diff(np.append(starts, len(self.values))).astype(np.int32)
        return self.levels[depth]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of ``depth`` its 0- and 1-child one level down, or -1."""
        if depth not in self.below:
            (starts, counts), (below, _) = self.level(depth), self.level(depth + 1)
            first = np.searchsorted(below, starts).astype(np.int32)
            two = np.searchsorted(below, starts + counts) - first == 2
            bit = (self.values[starts] >> np.uint64(63 - depth)) & np.uint64(1)
            self.below[depth] = (np.where(bit == 0, first, -1).astype(np.int32),
                                 np.where(two, first + 1, np.where(bit == 1, first, -1)).astype(np.int32))
        return self.below[depth]


def compare(a: Trie, b: Trie, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray,
            bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs between runs of at most LEAF fingerprints from ``x`` and from ``y``."""
    wide, deep = int(nx.max()), int(ny.max())
    left, found = a.padded[x[:, None] + np.arange(wide)], []
    for k in range(deep):
        near = np.bitwise_count(left ^ b.padded[y + k][:, None]) <= bits
        if near.any():
            r, c = np.nonzero(near)
            real = (c < nx[r]) & (k < ny[r])
            found.append((x[r[real]] + c[real], y[r[real]] + k))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, q = (np.concatenate(v) for v in zip(*found))
    return p, q


def similar(left: np.ndarray, right: np.ndarray, depth: int, spent: int, same: bool,
            bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in two nodes of ``depth`` at most ``bits`` apart.

    ``spent`` bits differ above; ``same``: both are one node, and a pair may come in
    both orders.
    Fronts of over FRONT pairs are halved, so memory follows the depth. Nodes of at
    most LEAF fingerprints are compared outright.
    """
    a = Trie(left, 0x5555555555555555)
    b = a if same else Trie(right, 0xAAAAAAAAAAAAAAAA)
    zero = np.zeros(1, np.int32)
    stack = [(depth, zero, zero, np.full(1, spent, np.int8))]
    while stack:
        depth, i, j, cost = stack.pop()
        if len(i) > FRONT:
            half = len(i) // 2
            stack.append((depth, i[:half], j[:half], cost[:half]))
            i, j, cost = i[half:], j[half:], cost[half:]
        (sa, na), (sb, nb) = a.level(depth), b.level(depth)
        ni, nj = na[i], nb[j]
        leaf = np.maximum(ni, nj) <= LEAF
        if leaf.any():
            x, y = compare(a, b, sa[i[leaf]], ni[leaf], sb[j[leaf]], nj[leaf], bits)
            if same:  # a pair within one node is met in both orders, its own image once
                x, y = x[x != y], y[x != y]
            if len(x):
                yield x, y
            i, j, cost = i[~leaf], j[~leaf], cost[~leaf]
        if not len(i):
            continue
        za, oa = a.children(depth)
        zb, ob = (za, oa) if same else b.children(depth)
        zi, oi, zj, oj = za[i], oa[i], zb[j], ob[j]
        able = cost < bits
        crossed = able & (i != j) if same else able  # a node with itself crosses once
        more = cost + np.int8(1)
        fronts = []
        for x, y, c, wanted in ((zi, zj, cost, None), (oi, oj, cost, None),
                                (zi, oj, more, able), (oi, zj, more, crossed)):
            there = (x >= 0) & (y >= 0)
            if wanted is not None:
                there &= wanted
            fronts.append((x[there], y[there], c[there]))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*fronts))))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the smallest one that the pairs connect it to."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def unit_links(left: bytes, right: bytes, depth: int, spent: int, same: bool, bits: int) -> pd.DataFrame:
    a = np.frombuffer(left, "<u8")
    b = a if same else np.frombuffer(right, "<u8")
    shift = 0 if same else len(a)
    pairs = ((x, y + shift) for x, y in similar(a, b, depth, spent, same, bits))
    root = spanning(len(a) + (0 if same else len(b)), pairs)
    values = (a if same else np.concatenate([a, b])).view("<i8")
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": values[linked], "b": values[root[linked]]})


# --- nodes and pairs of nodes ------------------------------------------------

def cut_trie(counts: dict[int, int], size: int) -> list[tuple[int, int]]:
    """Nodes (prefix, depth) of at most ``size`` fingerprints, or of PREFIX bits."""
    sums = [dict() for _ in range(PREFIX + 1)]
    sums[PREFIX] = counts
    for depth in range(PREFIX - 1, -1, -1):
        for p, n in sums[depth + 1].items():
            sums[depth][p >> 1] = sums[depth].get(p >> 1, 0) + n
    nodes, todo = [], [(0, 0)]
    while todo:
        p, depth = todo.pop()
        if p in sums[depth]:
            if depth == PREFIX or sums[depth][p] <= size:
                nodes.append((p, depth))
            else:
                todo += [(p * 2, depth + 1), (p * 2 + 1, depth + 1)]
    return sorted(nodes, key=lambda n: n[0] << (PREFIX - n[1]))


def links(distinct: DataFrame, bits: int = BITS, node_size: int | None = None) -> DataFrame:
    """Links (a, b) that connect all values of ``fp`` at most ``bits`` apart."""
    spark = distinct.sparkSession
    cell = F.shiftrightunsigned("fp", 64 - PREFIX).cast("int")
    counts = {r["cell"]: r["n"] for r in distinct.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    schema = "a long, b long"
    if not counts:
        return spark.createDataFrame([], schema)
    size = node_size or min(NODE_SIZE, max(2048, -(-sum(counts.values()) // NODES)))
    nodes = cut_trie(counts, size)
    low = np.array([p << (PREFIX - d) for p, d in nodes], np.int64)
    held = np.zeros(len(nodes), np.int64)
    np.add.at(held, np.searchsorted(low, list(counts), "right") - 1, list(counts.values()))
    pages = -(-held // size)  # a node beyond the size takes several rows, dealt by hash
    spread = F.broadcast(spark.createDataFrame(
        [(int(a), int(b), i, int(n)) for i, (a, b, n) in enumerate(
            zip(low, [*low[1:].tolist(), 1 << PREFIX], pages))], "lo int, hi int, node int, pages int"))

    def gather(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(batch["fp"].to_numpy().view("<u8"))
        return pd.DataFrame({"node": [key[0]], "page": [key[1]], "held": [values.tobytes()]})

    held_by = distinct.withColumn("cell", cell).join(
        spread, (F.col("cell") >= F.col("lo")) & (F.col("cell") < F.col("hi"))).select(
        "node", F.pmod(F.xxhash64("fp"), F.col("pages")).cast("int").alias("page"), "fp")
    held_by = stored(held_by.groupBy("node", "page").applyInPandas(
        gather, "node int, page int, held binary"), "nodes")

    def pairs() -> Iterator[tuple]:
        prefix, depth = (np.array([n[k] for n in nodes]) for k in (0, 1))
        for i, (p, d) in enumerate(nodes):
            common = np.minimum(d, depth[i:])
            spent = np.bitwise_count((p >> (d - common)) ^ (prefix[i:] >> (depth[i:] - common)))
            for k in np.flatnonzero(spent <= bits).tolist():
                for s in range(int(pages[i])):
                    for t in range(int(pages[i + k])):
                        if k or s <= t:
                            yield (i, s, i + k, t, int(common[k]), int(spent[k]), k == 0 and s == t)

    units = spark.createDataFrame(
        pairs(), "node int, page int, node2 int, page2 int, depth int, spent int, same boolean")
    right = held_by.selectExpr("node AS node2", "page AS page2", "held AS held2")
    # the partner of a node with itself is not sent a second time
    met = (units.join(held_by, ["node", "page"])
           .join(right, ["node2", "page2"])
           .withColumn("held2", F.when(~F.col("same"), F.col("held2"))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                unit = {c: batch.column(c)[r] for c in batch.schema.names}
                found = unit_links(unit["held"].as_buffer(), unit["held2"].as_buffer() or b"",
                                   unit["depth"].as_py(), unit["spent"].as_py(),
                                   unit["same"].as_py(), bits)
                yield pa.RecordBatch.from_pandas(
                    found, pa.schema([("a", pa.int64()), ("b", pa.int64())]), preserve_index=False)

    tasks = max(shuffle_partitions(spark), len(nodes))
    return met.repartition(tasks).mapInArrow(join, schema)


# --- components ----------------------------------------------------------------

def contract(edges: DataFrame) -> DataFrame:
    """``v`` and ``root``, one value for all that edges (a, b) connect.

    A round points every vertex at the least of its neighbours and itself, by a
    hash that changes with the round, and replaces vertices by what they point at;
    edges within a vertex go. Vertices that nothing points at vanish, about a third
    a round whatever the shape. Roots are looked up backwards at the end.
    """
    edges = stored(edges.filter("a <> b"), "edges")
    rounds = []
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(rounds)), F.col(c))  # noqa: E731, B023
        both = edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        to = stored(least.select(F.col("a").alias("v"), F.when(rank("b") < rank("a"), F.col("b"))
                                 .otherwise(F.col("a")).alias("root")), "round")
        rounds.append(to)
        ends = edges.join(to.selectExpr("v AS a", "root AS ra"), "a").join(
            to.selectExpr("v AS b", "root AS rb"), "b")
        edges = stored(ends.filter("ra <> rb").selectExpr("ra AS a", "rb AS b").distinct(), "edges")
    if not rounds:
        return edges.selectExpr("a AS v", "b AS root")
    roots = rounds.pop()
    while rounds:
        later = roots.selectExpr("v AS root", "root AS end")
        roots = stored(rounds.pop().join(later, "root", "left").selectExpr(
            "v", "coalesce(end, root) AS root"), "roots")
    return roots


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS,
               node_size: int | None = None) -> DataFrame:
    """One row a document: doc_id, mark, fp, component_id and the component's root."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(
        F.min(ID).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = stored(contract(links(distinct.select("fp"), bits, node_size)), "components")
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    # few fingerprints share a root unless linked; partial minima come first
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    members = stored(named, "members")
    labels = stored(join_groups(members.select("fp", "n", "root"), ids, "root", "k", distinct.count())
                    .select("fp", "n", "component_id", "root"), "labels")
    return join_groups(rows, labels, "fp", "n", rows.count()).select(
        ID, "mark", "fp", "component_id", "root")


def keep(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest doc_id."""
    kept = components(docs, words, bits).filter(F.col(ID).eqNullSafe(F.col("component_id"))).select(
        F.coalesce(ID, F.lit(0)).alias("id"), F.col(ID).isNull().alias("none"), "mark", "root").distinct()
    rows = packed_rows(docs, F.coalesce(F.col(ID).cast("long"), F.lit(0)).alias("id"),
                       F.col(ID).isNull().alias("none"), F.xxhash64(body()).alias("mark"),
                       hash_of_row(docs).alias("order"))
    first = F.row_number().over(W.partitionBy("root").orderBy("order"))
    return (rows.join(kept, ["id", "none", "mark"])
            .withColumn("at", first).filter("at = 1").select("row.*"))
