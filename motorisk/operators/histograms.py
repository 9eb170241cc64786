"""Histograms and band tables.

Bin statistics (min / max) are one scalar subquery; each row gets its bin
id by a column expression, counts are a partial + final aggregate, and the
result is joined to a bin dimension of k rows so empty bins are kept.
Nothing is collected: cost is one scan for the statistics and one for the
counts, whatever the table size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bands as B


def _range_stats(df: DataFrame, col: str):
    s = df.select(F.struct(F.min(col).cast("double").alias("lo"),
                           F.max(col).cast("double").alias("hi"))).scalar()
    return s.getField("lo"), s.getField("hi")


def _bin_dimension(spark: SparkSession, k: int) -> DataFrame:
    return spark.range(1, k + 1).select(F.col("id").cast("int").alias("bin"))


def _round(c, digits=6):
    return F.round(c, digits)


def cut_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """F27 + J2: counts per right-closed equal-width interval, empty kept."""
    lo, hi = _range_stats(df, col)
    counts = (df.where(F.col(col).isNotNull())
              .select(B.equal_width_cut(F.col(col).cast("double"), lo, hi, k).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    dim = _bin_dimension(df.sparkSession, k)
    low, high = B.cut_edges(lo, hi, k, F.col("bin"))
    return (dim.join(counts, "bin", "left")
            .select("bin", _round(low).alias("lo"), _round(high).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def with_cut_column(df: DataFrame, col: str, k: int = 10, out: str | None = None) -> DataFrame:
    """Append the interval number of each row as a new column."""
    lo, hi = _range_stats(df, col)
    return df.withColumn(out or f"binned_{col}",
                         B.equal_width_cut(F.col(col).cast("double"), lo, hi, k))


def histogram(df: DataFrame, col: str | None = None, k: int = 10, expr=None) -> DataFrame:
    """Left-closed equal-width histogram over [min, max], empty bins kept.
    ``expr`` histograms a derived value (A23 passes a log)."""
    value = expr if expr is not None else F.col(col)
    vals = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    lo, hi = _range_stats(vals, "v")
    counts = (vals.select(B.histogram_bin("v", lo, hi, k).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    rlo, rhi = B.histogram_range(lo, hi)
    w = (rhi - rlo) / F.lit(float(k))
    dim = _bin_dimension(df.sparkSession, k)
    return (dim.join(counts, "bin", "left")
            .select("bin",
                    _round(rlo + (F.col("bin") - 1) * w).alias("lo"),
                    _round(F.when(F.col("bin") == k, rhi).otherwise(rlo + F.col("bin") * w)).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def fixed_edge_histogram(df: DataFrame, col: str, edges: Sequence[float],
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts over literal edges; values outside the edges are dropped.
    With ``group_cols`` one histogram per group (e.g. per model and split)."""
    n = len(edges) - 1
    counts = (df.select(*group_cols, B.fixed_edge_bin(F.col(col), edges).alias("bin"))
              .where(F.col("bin").isNotNull())
              .groupBy(*group_cols, "bin").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(j + 1, float(edges[j]), float(edges[j + 1])) for j in range(n)],
        T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("lo", T.DoubleType()),
                      T.StructField("hi", T.DoubleType())]))
    if group_cols:
        groups = counts.select(*group_cols).distinct()
        dim = _cross_small(groups, dim)
    out = dim.join(counts, [*group_cols, "bin"], "left")
    return out.select(*group_cols, "bin", _round(F.col("lo")).alias("lo"), _round(F.col("hi")).alias("hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def _cross_small(groups: DataFrame, dim: DataFrame) -> DataFrame:
    """Every group with every bin: both sides are small (groups x bins)."""
    bins = dim.agg(F.collect_list(F.struct("bin", "lo", "hi")).alias("b")).scalar()
    return groups.select("*", F.explode(bins).alias("_b")).select(
        *groups.columns, "_b.bin", "_b.lo", "_b.hi")


def band_table(df: DataFrame, value_col: str, target_col: str,
               edges: Sequence[float] = B.EXPERIENCE_EDGES,
               labels: Sequence[str] = B.EXPERIENCE_LABELS, band_col: str = "band") -> DataFrame:
    """A7 + A8 + J2: rate, count and sum of the target per right-closed band,
    every band kept (empty: count 0, rate NULL), with the base rate and the
    lift of each band over it."""
    banded = df.select(B.right_closed_band(value_col, edges, labels).alias(band_col),
                       F.col(target_col).alias("t"))
    # One grouped pass; its few rows (a band each, rows outside every band the
    # NULL one) become one row that holds them all, the base rate included.
    grouped = banded.groupBy(band_col).agg(
        F.avg("t").alias("rate"), F.count("t").alias("count"), F.sum("t").alias("total"))
    entry = F.when(F.col(band_col).isNotNull(), F.struct(band_col, F.struct("rate", "count", "total")))
    whole = grouped.agg(F.try_divide(F.sum("total"), F.sum("count")).alias("base"),
                        F.map_from_entries(F.collect_list(entry)).alias("bands"))
    listed = whole.select("base", "bands", F.posexplode(F.array(*[F.lit(lab) for lab in labels])).alias("at", band_col))
    s = F.try_element_at("bands", F.col(band_col))
    return listed.select("at", band_col, "base", s.alias("s")).select(
        band_col, (F.col("at") + 1).cast("int").alias("band_order"),
        F.round("s.rate", 4).alias("claims_rate"),
        F.coalesce(F.col("s.count"), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.col("s.total"), F.lit(0)).cast("bigint").alias("total_claims"),
        F.round("base", 4).alias("base_rate"),
        F.round(F.try_divide(F.col("s.rate"), F.col("base")), 4).alias("lift"),
    )
