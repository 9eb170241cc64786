"""Order-dependent primitives without a single-partition window.

* ``row_index``: 0-based position of every row in a total order, optionally
  restarting per group.
* ``value_positions``: for every distinct value, how many rows (of its group)
  sort before it. Average ranks are derived from it.
* ``even_slice``: slice number of a row index when n rows are cut into k even
  slices (the first n mod k slices get one row more).

How the order is computed: the frame is range-partitioned on the order
columns and sorted inside each partition, so every partition holds one
contiguous run of the order. The per-partition totals (one row per partition,
or per partition and group) are the only thing that crosses partitions; their
running sum gives each partition its offset. Partition number and position
are written with the rows to a table in the shared checkpoint folder
(``materialize``) before the totals are taken: range sampling may cut
differently when a plan is executed again, and then offsets and rows would
disagree; stored values cannot.

Nothing here gathers a group into one task: a hot value (a third of all rows
with the same value) becomes one row of the distinct-value frame after the
map-side partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .materialize import materialize
from .selection import exact_quantiles  # noqa: F401  (positions of an order without sorting)

PART = "_part"
LOCAL = "_local"


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _range_sorted(df: DataFrame, order: list[Column], partitions: int | None,
                  bucket: Column | None = None) -> DataFrame:
    """Rows with ``PART`` (a run of the order) and ``LOCAL`` (position of the
    row in its physical partition), written once.

    Without ``bucket`` the runs are range partitions (Spark samples the input
    for the bounds). With ``bucket`` (an int that never decreases along the
    order, e.g. from a uniform hash) no sampling pass is needed: rows are
    hash-partitioned on the bucket and sorted by (bucket, order), so each
    bucket is contiguous inside its partition."""
    n = partitions or shuffle_partitions(df.sparkSession)
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    if bucket is None:
        ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        return materialize(ranged.withColumns({PART: F.spark_partition_id(), LOCAL: local}), "ranged")
    bucketed = df.withColumn(PART, bucket.cast("int")).repartition(n, PART).sortWithinPartitions(PART, *order)
    return materialize(bucketed.withColumn(LOCAL, local), "ranged")


def _partition_offsets(totals: DataFrame, group_cols: Sequence[str], size_col: str) -> DataFrame:
    """Running sum of ``size_col`` over earlier partitions of the same group.

    ``totals`` has one row per (partition, group): at most partitions + groups
    rows. Without groups it is collected (one number per partition, a bound set
    by the session) and returned as a small literal frame for a broadcast join.
    """
    if not group_cols:
        rows = sorted(totals.select(PART, size_col).collect())
        acc, data = 0, []
        for part, size in rows:
            data.append((int(part), int(acc)))
            acc += int(size)
        return totals.sparkSession.createDataFrame(data, f"{PART} int, _offset long")
    w = Window.partitionBy(*group_cols).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group_cols, PART, F.coalesce(F.sum(size_col).over(w), F.lit(0)).alias("_offset"))


def row_index(df: DataFrame, order_cols: Sequence[str | Column], out: str = "row_index",
              group_cols: Sequence[str] = (), partitions: int | None = None,
              bucket: Column | None = None) -> DataFrame:
    """Add ``out`` = 0-based position in the order of ``order_cols`` (within
    ``group_cols``). ``order_cols`` must make the order total (end with a key)."""
    return row_index_and_count(df, order_cols, out, group_cols, partitions, bucket)[0]


def row_index_and_count(df: DataFrame, order_cols: Sequence[str | Column], out: str = "row_index",
                        group_cols: Sequence[str] = (), partitions: int | None = None,
                        bucket: Column | None = None) -> tuple[DataFrame, int | None]:
    """``row_index`` plus the row count (ungrouped only, else None), taken
    from the per-partition totals so no extra pass is needed. ``bucket``
    (ungrouped only) replaces range sampling, see ``_range_sorted``."""
    if bucket is not None and group_cols:
        raise ValueError("bucket is for ungrouped indexes")
    order = [*_cols(group_cols), *_cols(order_cols)]
    ranged = _range_sorted(df, order, partitions, bucket)
    totals = ranged.groupBy(PART, *group_cols).agg(
        F.count(F.lit(1)).alias("_size"), F.min(LOCAL).alias("_first"))
    keys = [PART, *group_cols]
    if group_cols:
        meta = _partition_offsets(totals, group_cols, "_size").join(totals.select(*keys, "_first"), keys)
        out_df, n = ranged.join(meta, keys), None
    else:
        # one row per partition: a bound set by the session, not by the data
        acc, data = 0, []
        for part, size, first in sorted(totals.select(PART, "_size", "_first").collect()):
            data.append((int(part), acc, int(first)))
            acc += int(size)
        meta = df.sparkSession.createDataFrame(data, f"{PART} int, _offset long, _first long")
        out_df, n = ranged.join(F.broadcast(meta), keys), acc
    return out_df.withColumn(out, F.col("_offset") + F.col(LOCAL) - F.col("_first")).drop(
        PART, LOCAL, "_offset", "_first"), n


def value_positions(df: DataFrame, value: str | Column, group_cols: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """Distinct values with ``w`` (rows holding the value) and ``before``
    (rows of the same group with a smaller value). NULL values are skipped."""
    return _value_positions(df, value, group_cols, partitions)[0]


def _value_positions(df: DataFrame, value: str | Column, group_cols: Sequence[str] = (),
                     partitions: int | None = None) -> tuple[DataFrame, int]:
    """``value_positions`` and the number of non-NULL rows over all groups,
    read from the per-partition totals of the written stage."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*group_cols, v.alias("v")).where(F.col("v").isNotNull())
              .groupBy(*group_cols, "v").agg(F.count(F.lit(1)).alias("w")))
    ranged = _range_sorted(counts, [*_cols(group_cols), F.col("v")], partitions)
    totals = ranged.groupBy(PART, *group_cols).agg(F.sum("w").alias("_size"))
    offsets = _partition_offsets(totals, group_cols, "_size")
    total = int(totals.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0])
    keys = [PART, *group_cols]
    joined = ranged.join(F.broadcast(offsets) if not group_cols else offsets, keys)
    within = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *group_cols, "v", "w",
        (F.col("_offset") + F.coalesce(F.sum("w").over(within), F.lit(0))).alias("before")), total


def average_rank(df: DataFrame, value: str, out: str, group_cols: Sequence[str] = (),
                 partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of ``value`` with ties given the mean rank
    (pandas ``rank()`` / ``method='average'``). NULL stays NULL.

    The ranks go back to the rows by a join on the value. A value held by
    more rows than an average partition is hot; there are at most as many
    hot values as partitions, so their ranks are broadcast and their rows
    never shuffle. The other rows join the remaining ranks by an ordinary
    shuffle join, in which no key is hot any more."""
    n = partitions or shuffle_partitions(df.sparkSession)
    pos, total = _value_positions(df, value, group_cols, partitions)
    ranks = pos.select(*group_cols, F.col("v").alias(value), "w",
                       (F.col("before") + (F.col("w") + 1) / 2.0).alias(out))
    threshold = F.lit(total / n)
    hot = ranks.where(F.col("w") > threshold).drop("w")
    cold = ranks.where(F.col("w") <= threshold).drop("w")
    keys = [*group_cols, value]
    with_hot = df.join(F.broadcast(hot), keys, "left")
    hot_rows = with_hot.where(F.col(out).isNotNull())
    other = with_hot.where(F.col(out).isNull()).drop(out)
    return hot_rows.unionByName(other.join(cold, keys, "left"))


def even_slice(index: str | Column, n: Column, k: int) -> Column:
    """Slice 0..k-1 of 0-based row ``index`` when n rows are cut into k even
    slices; the first n mod k slices hold one row more."""
    i = F.col(index) if isinstance(index, str) else index
    q = F.floor(n / F.lit(k)).cast("long")
    r = (n - q * F.lit(k)).cast("long")
    big = r * (q + 1)
    return F.when(i < big, F.floor(i / (q + 1))).otherwise(
        r + F.floor((i - big) / F.greatest(q, F.lit(1)))).cast("int")
