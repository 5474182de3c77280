"""Global positions, take / skip and sorting without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tandem.session import cut_lineage, shuffle_partitions

_ROW_BITS = 33  # monotonically_increasing_id: partition << 33 | row in partition
_ROW_MASK = (1 << _ROW_BITS) - 1
# Keys the driver looks at, at most, in one pass of the search for a rank.
_SAMPLE = 10_000


def _partition_no() -> Column:
    return F.shiftrightunsigned(F.col("_mid"), _ROW_BITS)


def _row_in_partition() -> Column:
    return F.col("_mid").bitwiseAND(F.lit(_ROW_MASK))


def with_global_index(df: DataFrame, *order_by: str, name: str = "idx", start: int = 1) -> DataFrame:
    """Dense numbers in the order of ``order_by``, which must identify a row.

    Range sort, then one offset per partition: the only table that is ever
    gathered has one row per partition, so nothing runs on all rows at once.
    """
    n = shuffle_partitions(df.sparkSession)
    ordered = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    stamped = cut_lineage(ordered).withColumn("_mid", F.monotonically_increasing_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stamped.groupBy(_partition_no().alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stamped.withColumn("_part", _partition_no())
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_offset") + _row_in_partition() + F.lit(start)).cast("long"))
        .drop("_mid", "_part", "_offset")
    )


def running_total(df: DataFrame, order_by: str, value: str, name: str) -> DataFrame:
    """Cumulative sum of ``value`` in the order of ``order_by``, two-level.

    Sums run inside slices of the order; one offset per slice is added after.
    """
    slices = shuffle_partitions(df.sparkSession)
    n = df.count()
    per_slice = max(1, -(-n // slices))
    cut = with_global_index(df, order_by, name="_idx", start=0).withColumn(
        "_slice", F.floor(F.col("_idx") / F.lit(per_slice)))
    inside = Window.partitionBy("_slice").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_slice").agg(F.sum(value).alias("_sum"))
        .select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        cut.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_slice")  # at most one row per slice
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_idx", "_slice", "_inside", "_offset")
    )


def _key_type(df: DataFrame, order_by: tuple[str, ...]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in order_by) + ">"


def _key(order_by: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in order_by])


def _literal(row: Row, order_by: tuple[str, ...], kind: str) -> Column:
    """A key as a literal; structs compare field by field, null before all else, as sorting does."""
    return F.struct(*[F.lit(row[c]).alias(c) for c in order_by]).cast(kind)


def order_statistic(df: DataFrame, *order_by: str, rank: int) -> tuple[Row, int, int] | None:
    """The key of the ``rank``-th row (from 1), and how many rows lie below it and share it.

    None if there are fewer rows. Nothing is sorted or shuffled but a sample of at
    most ``_SAMPLE`` keys: two of its keys bracket the rank, one pass counts the
    rows up to each, and the search goes on between them. A pass keeps about 6 of
    100 rows, so 10^12 rows take some seven passes over the key columns. A sample
    that misses costs another pass, never a wrong result.
    """
    kind, key = _key_type(df, order_by), _key(order_by)
    keys = df.select(*order_by)
    total = keys.count()
    if not 1 <= rank <= total:
        return None
    within, below, left = F.lit(True), 0, total
    while left > _SAMPLE:
        inside = keys.filter(within)
        sample = inside.orderBy(F.xxhash64(*order_by)).limit(_SAMPLE).orderBy(*order_by).collect()
        spot, slack = (rank - below) / left * len(sample), 3 * len(sample) ** 0.5
        low_row = sample[max(0, int(spot - slack))]
        low = _literal(low_row, order_by, kind)
        high = _literal(sample[min(len(sample) - 1, int(spot + slack))], order_by, kind)
        n = inside.agg(F.count_if(key < low).alias("under"), F.count_if(key == low).alias("same"),
                       F.count_if(key <= high).alias("upto")).first()
        at, through = rank - below, n["under"] + n["same"]
        if at <= n["under"]:
            within, left = within & (key < low), n["under"]
        elif at <= through:
            return low_row, below + n["under"], n["same"]
        elif at <= n["upto"]:
            within, below, left = within & (key > low) & (key <= high), below + through, n["upto"] - through
        else:
            within, below, left = within & (key > high), below + n["upto"], left - n["upto"]
    # each key once with its rows: at most _SAMPLE of them
    for row in keys.filter(within).groupBy(*order_by).agg(F.count(F.lit(1)).alias("_n")).orderBy(*order_by).collect():
        if rank <= below + row["_n"]:
            return row, below, row["_n"]
        below += row["_n"]
    return None


def skip_take(df: DataFrame, *order_by: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Drop the first ``offset`` rows of the order, keep the next ``limit``.

    The keys at the two ends are found by counting (``order_statistic``); the
    window then is a filter on ``df``, which neither sorts nor stores it, and which
    prunes files by the first column of the order. Rows that share the key at an
    end are cut by a hash of the whole row.
    """
    if limit is not None and limit <= 0:
        return df.limit(0)
    kind, key = _key_type(df, order_by), _key(order_by)
    lead = F.col(order_by[0])
    kept, ties = F.lit(True), []
    first = order_statistic(df, *order_by, rank=offset + 1) if offset > 0 else None
    if offset > 0:
        if first is None:
            return df.limit(0)
        row, below, same = first
        at = _literal(row, order_by, kind)
        if offset == below:
            kept = kept & (key >= at)
        else:
            kept = kept & (key > at)
            ties.append((at, offset - below, min(same, same if limit is None else offset - below + limit)))
        if row[order_by[0]] is not None:
            kept = kept & (lead >= _literal(row, order_by[:1], _key_type(df, order_by[:1]))[order_by[0]])
    last = None if limit is None else order_statistic(df, *order_by, rank=offset + limit)
    if last is not None:
        row, below, same = last
        at = _literal(row, order_by, kind)
        if offset + limit == below + same:
            kept = kept & (key <= at)
        else:
            kept = kept & (key < at)
            if below >= offset:  # else the same rows are cut at both ends, once
                ties.append((at, 0, offset + limit - below))
        if row[order_by[0]] is not None:
            kept = kept & (F.isnull(lead) | (
                lead <= _literal(row, order_by[:1], _key_type(df, order_by[:1]))[order_by[0]]))
    window = df.filter(kept)
    for at, start, end in ties:
        window = window.unionByName(
            df.filter(key == at).orderBy(F.xxhash64(*df.columns)).offset(start).limit(end - start))
    return window


def short_input_report(df: DataFrame, offset: int) -> DataFrame:
    """One row saying how many rows exist and whether the offset exceeds them."""
    return df.agg(F.count(F.lit(1)).alias("available")).select(
        "available", F.lit(offset).cast("long").alias("offset"),
        (F.col("available") < offset).alias("too_short"))


def take_first(df: DataFrame, *order_by: str, n: int) -> DataFrame:
    """The first ``n`` rows in order: every task keeps its own first ``n`` only."""
    return df.orderBy(*order_by).limit(n)


def take_per_partition(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every partition, without moving any row."""
    return (
        df.withColumn("_mid", F.monotonically_increasing_id())
        .filter(_row_in_partition() < n)
        .drop("_mid")
    )


def take_per_file(lines: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """The first ``n`` lines of every file; a plain filter, as lines are numbered."""
    return lines.filter(F.col(line_no) <= n)


def sort_rows(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys)
