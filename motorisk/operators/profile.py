"""Data profile (G6): shape, types, describe, nulls, missing patterns,
duplicates, category shares, box-plot statistics, kernel density, dispersion.

Every statistic is an aggregate: columns are unpivoted into
(``feature``, ``value``) rows so that one grouped job covers all columns,
exact quantiles come from ``ordering.exact_quantiles`` (distinct values
only, never a per-group buffer of rows), and per-column totals are tiny
frames joined back by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bands as B
from . import ordering as O
from .materialize import Stages, materialize
from .membership import likely_members
from .moments import pair_moments
from .selection import select_rows

# Box-plot whisker reach in IQRs, kernel grid size.
WHISKER_IQR = 1.5
KDE_GRID = 200
# Cells the values are counted in before the kernel sum.
KDE_CELLS = 1024
SQRT_2PI = math.sqrt(2 * math.pi)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_values(df: DataFrame, columns: Sequence[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``columns`` into (feature, value) rows; missing values (NULL, and NaN among doubles) are dropped."""
    long = df.select(*[F.col(c).cast(value_type).alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value").where(F.col("value").isNotNull())
    return long.where(~F.isnan("value")) if value_type == "double" else long


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns as one row."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def column_types(df: DataFrame) -> DataFrame:
    """P4 / P13 ``info``: column, position, kind, Spark type and non-null count."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(kind_of(f.dataType)))])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return counts.unpivot([], df.columns, "feature", "non_null").select(
        "feature", pos[F.col("feature")].alias("position"), kinds[F.col("feature")].alias("kind"),
        types[F.col("feature")].alias("spark_type"), F.col("non_null").cast("bigint"))


def null_counts(df: DataFrame) -> DataFrame:
    """A13 (+ P12 transpose): one pass of ``count_if(isnull)``, then one row per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "feature", "nulls").select(
        "feature", F.col("nulls").cast("bigint"))


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which columns are missing together, with the row count of each pattern."""
    cols = list(columns or df.columns)
    flags = [F.when(F.col(c).isNull(), F.lit(c)) for c in cols]
    pattern = F.concat_ws(",", *flags)
    return df.groupBy(pattern.alias("missing_columns")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.max(F.size(F.array_compact(F.array(*flags)))).cast("int").alias("n_missing"))


def duplicate_count(df: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Rows beyond the first occurrence of each full row (NULLs equal).

    128-bit fingerprints of the rows are counted first. Only rows whose
    fingerprint was seen twice are grouped by all their columns, so unequal rows
    that share one are told apart and rows of their own are never shuffled."""
    stages = stages or Stages(df.sparkSession)
    # one zero: 0.0 and -0.0 are equal rows
    same = [F.col(f.name) + 0.0 if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    texts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in same]
    marked = df.select("*", F.xxhash64(*texts).alias("_h1"), F.xxhash64(F.lit("2"), *reversed(texts)).alias("_h2"))
    seen = marked.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h1", "_h2")
    twice = stages.write(seen, "seen-twice")
    n = twice.count()
    if not n:
        stages.drop(twice)
        return df.sparkSession.createDataFrame([(0,)], "duplicates long")
    suspects = likely_members(marked, "_h1", twice, "_h1", n).join(twice, ["_h1", "_h2"], "left_semi")
    groups = suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column mean, sample std, min, quartiles, max (count dropped).

    Quartiles are exact (linear interpolation). With an infinite value the std
    is undefined (NULL)."""
    lv = materialize(long_values(df, columns), "long-values")
    moments = lv.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.when(~F.bool_or(F.abs("value") == float("inf")), F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = O.exact_quantiles(lv, "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"], group_cols=["feature"], stored=True)
    return moments.join(q, "feature").select("feature", "mean", "std", "min", "q25", "median", "q75", "max")


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percent of each value per column, NULL
    excluded, most frequent value first within each column."""
    lv = long_values(df, columns, "string")
    counts = lv.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("feature").agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "value", F.col("count").cast("bigint"),
        (F.col("count") * 100.0 / F.col("_total")).alias("percent")).orderBy("feature", F.desc("count"), "value")


def group_summary(df: DataFrame, by: str, count_col: str, mean_col: str,
                  count_name: str = "policy_count", mean_name: str | None = None) -> DataFrame:
    """Count of one column and mean of another per category."""
    return df.groupBy(by).agg(F.count(count_col).cast("bigint").alias(count_name),
                              F.avg(mean_col).alias(mean_name or mean_col))


def boxplot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 IQR of the
    box, and the number of values beyond the whiskers, per column."""
    lv = materialize(long_values(df, columns), "long-values")
    q = O.exact_quantiles(lv, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], group_cols=["feature"], stored=True)
    fences = q.select("feature", "q1", "median", "q3",
                      (F.col("q3") - F.col("q1")).alias("iqr"),
                      (F.col("q1") - WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("_hi"))
    v = F.col("value")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    stats = lv.join(F.broadcast(fences.select("feature", "_lo", "_hi")), "feature").groupBy("feature").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).cast("bigint").alias("outliers"))
    return fences.drop("_lo", "_hi").join(stats, "feature")


def kde_curve(df: DataFrame, column: str, grid: int = KDE_GRID) -> DataFrame:
    """Gaussian kernel density on ``grid`` evenly spaced points over
    [min, max], bandwidth by Scott's rule (sample std · n^(-1/5)).

    The values are first counted in ``KDE_CELLS`` equal cells of the range,
    each standing at the mean of its values, so the work is grid × cells for
    any column."""
    vals = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    st = vals.select(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"),
                              F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))).scalar()
    lo, hi, n, sd = st.getField("lo"), st.getField("hi"), st.getField("n").cast("double"), st.getField("sd")
    bw = sd * F.pow(n, F.lit(-0.2))
    step = (hi - lo) / F.lit(float(grid - 1))
    cell = F.when(hi > lo, F.least(F.lit(KDE_CELLS - 1), F.floor((F.col("v") - lo) / ((hi - lo) / F.lit(float(KDE_CELLS)))))).otherwise(F.lit(0))
    weighted = vals.groupBy(cell.alias("cell")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("w"))
    pts = weighted.select("v", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    x = lo + F.col("point") * step
    z = (x - F.col("v")) / bw
    contrib = F.col("w") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.groupBy("point").agg(F.sum(contrib).alias("_s"))
    return dens.select(F.col("point").cast("int"), x.alias("x"),
                       (F.col("_s") / (n * bw * F.lit(SQRT_2PI))).alias("density"))


def dispersion(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample variance, variance / mean and the zero share."""
    y = F.col(target).cast("double")
    return df.agg(F.avg(y).alias("mean"), F.var_samp(y).alias("variance"),
                  F.try_divide(F.var_samp(y), F.avg(y)).alias("dispersion_ratio"),
                  F.avg(F.when(y == 0, 1.0).otherwise(0.0)).alias("zero_share"),
                  F.count(y).cast("bigint").alias("n_rows"))


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """First n rows in a stated order (TakeOrdered: n rows per task)."""
    return df.orderBy(*order).limit(n)


# Bins of the report's histograms.
REPORT_BINS = 10


def profile_report(df: DataFrame, key: str) -> DataFrame:
    """The whole profile as (section, feature, stat, value) rows.

    The frame is read once and written; passes over the columns they need of the
    stored rows give all sections but the quartiles: missing values per column and
    patterns of missing columns; categories; moments per numeric column and
    products per pair of them (``moments.pair_moments``); and, once ranges and
    quartiles are known, histogram bins and cells with the whiskers.
    NaN is missing in the numeric sections; ``key`` is no feature.

    Sections: shape, duplicates, nulls (per column), missing (rows per set of
    columns missing together), describe, category (count and percent per value),
    histogram (rows per bin), box, kde (density at ``KDE_GRID`` points), correlation
    (per pair; NULL for a constant column)."""
    stages = Stages(df.sparkSession)
    rows = stages.write(df, "profile")
    columns = df.columns
    numeric, texts = [c for c in numeric_columns(df) if c != key], text_columns(df)
    first = stages.write(_summary(rows, columns, numeric, texts, stages), "summary")
    long = long_values(rows, numeric)
    cuts = select_rows(long, ["feature"], ["value"], 6, _quartile_ends, stages)
    quartiles = _quartiles(cuts)
    ranges = (first.where("section = 'numeric'").select("feature", F.col("low").alias("lo"), F.col("high").alias("hi"), "n", F.col("sd")))
    shape_of = stages.write(ranges.join(quartiles, "feature"), "ranges")
    second = stages.write(_cells(long, shape_of), "cells")
    tell = lambda frame, section, feature, stat, value: frame.select(
        F.lit(section).alias("section"), feature.alias("feature"), stat.alias("stat"), value.cast("double").alias("value"))
    f, item, n = F.col("feature"), F.col("item"), F.col("n")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).alias("columns")).unpivot([], ["rows", "columns"], "feature", "value")
    out = tell(total, "shape", f, F.lit("count"), F.col("value"))
    out = out.unionByName(tell(duplicate_count(rows.drop(key), stages), "duplicates", F.lit("all"), F.lit("count"), F.col("duplicates")))
    counted = F.map_from_entries(F.collect_list(F.struct("feature", "n")))
    nulls = first.where("section = 'nulls'").agg(counted.alias("m")).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0)).alias("n")) for c in columns])).alias("e")).select("e.*")
    out = out.unionByName(tell(nulls, "nulls", f, F.lit("count"), n))
    out = out.unionByName(tell(first.where("section = 'missing'"), "missing", f, F.lit("rows"), n))
    stats = ("mean", "std", "min", "q25", "median", "q75", "max")
    described = first.where("section = 'numeric'").join(quartiles, "feature").select(
        "feature", "mean", F.col("sd").alias("std"), F.col("low").alias("min"), F.col("q1").alias("q25"), "median", F.col("q3").alias("q75"), F.col("high").alias("max"))
    described = described.unpivot(["feature"], list(stats), "stat", "value")
    out = out.unionByName(tell(described, "describe", f, F.col("stat"), F.col("value")))
    categories = first.where("section = 'category'")
    totals = categories.groupBy("feature").agg(F.sum("n").alias("total"))
    shares = categories.join(totals, "feature").select("feature", "item", n.cast("double").alias("count"), (n * 100.0 / F.col("total")).alias("percent"))
    shares = shares.unpivot(["feature", "item"], ["count", "percent"], "what", "value")
    out = out.unionByName(tell(shares, "category", f, F.concat_ws(" ", "what", "item"), F.col("value")))
    bins = shape_of.select("feature", F.explode(F.sequence(F.lit(1), F.lit(REPORT_BINS))).alias("place"))
    filled = bins.join(second.where("kind = 'bin'").select("feature", "place", "n"), ["feature", "place"], "left")
    out = out.unionByName(tell(filled, "histogram", f, F.concat(F.lit("bin "), F.col("place")), F.coalesce("n", F.lit(0))))
    whiskers = second.where("kind = 'cell'").groupBy("feature").agg(
        F.min("low").alias("whisker_low"), F.max("high").alias("whisker_high"), F.sum("outside").cast("double").alias("outliers"))
    box = shape_of.join(whiskers, "feature").select("feature", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "whisker_low", "whisker_high", "outliers")
    box = box.unpivot(["feature"], ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers"], "stat", "value")
    out = out.unionByName(tell(box, "box", f, F.col("stat"), F.col("value")))
    out = out.unionByName(tell(_densities(second, shape_of), "kde", f, F.concat(F.lit("point "), F.col("point")), F.col("density")))
    pairs = first.where("section = 'pair'").select("feature", "item", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))
    return out.unionByName(tell(pairs, "correlation", f, item, F.col("r")))


def _summary(rows: DataFrame, columns: Sequence[str], numeric: Sequence[str], texts: Sequence[str], stages: Stages) -> DataFrame:
    """Rows, moments and products per (section, feature, item): one pass for the
    missing values, one for the categories, one for the numbers."""
    gone = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    patterns = stages.write(rows.groupBy(gone.alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]), "patterns")
    nulls = patterns.agg(*[F.sum(f"n{i}").alias(c) for i, c in enumerate(columns)]).unpivot([], list(columns), "feature", "n")
    parts = [nulls.select(F.lit("nulls").alias("section"), "*"), patterns.select(F.lit("missing").alias("section"), "feature", "n")]
    if texts:
        counts = long_values(rows, texts, "string").groupBy("feature", F.col("value").alias("item")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.select(F.lit("category").alias("section"), "*"))
    parts.append(pair_moments(rows, numeric, stages).select(
        F.when(F.col("item").isNull(), "numeric").otherwise("pair").alias("section"), "*"))
    out = parts[-1]
    for part in parts[:-1]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _quartile_ends(n: Column, t: Column) -> Column:
    at = (F.floor(t / 2) + 1) * 0.25 * (n - 1).cast("double")
    return F.when(t % 2 == 0, F.floor(at)).otherwise(F.ceil(at))


def _quartiles(cuts: DataFrame) -> DataFrame:
    """(feature, q1, median, q3) from the values around the quartiles."""
    ends = cuts.groupBy("feature").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("t") == t, F.col("value"))).alias(f"e{t}") for t in range(6)])

    def quartile(k: int) -> Column:
        at, low, high = F.lit((k + 1) * 0.25) * (F.col("n") - 1).cast("double"), F.col(f"e{2 * k}"), F.col(f"e{2 * k + 1}")
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))
    return ends.select("feature", quartile(0).alias("q1"), quartile(1).alias("median"), quartile(2).alias("q3"))


def _cells(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """One pass: rows per histogram bin and per cell of the kernel sum, with the
    cells' means, their values nearest the whiskers' reach and the rows beyond."""
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    reach = WHISKER_IQR * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    cell = F.when(hi > lo, F.least(F.lit(KDE_CELLS - 1), F.floor((v - lo) / ((hi - lo) / F.lit(float(KDE_CELLS))))).cast("int")).otherwise(F.lit(0))
    both = F.array(F.struct(F.lit("bin").alias("kind"), B.histogram_bin("value", lo, hi, REPORT_BINS).alias("place")),
                   F.struct(F.lit("cell").alias("kind"), cell.alias("place")))
    # the ranges are a row per feature
    placed = long.join(ranges, "feature").select("feature", "value", inside.alias("inside"), F.inline(both))
    return placed.groupBy("feature", "kind", "place").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min(F.when(F.col("inside"), v)).alias("low"),
        F.max(F.when(F.col("inside"), v)).alias("high"), F.count_if(~F.col("inside")).alias("outside"))


def _densities(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(feature, point, density) on an even grid over each feature's range, from the counted cells."""
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("rows").cast("double")
    bw = F.col("sd") * F.pow(n, F.lit(-0.2))
    points = (cells.where("kind = 'cell'").join(ranges.select("feature", "lo", "hi", F.col("n").alias("rows"), "sd").where("sd > 0"), "feature")
              .select("feature", "n", "mean", lo, hi, "rows", bw.alias("bw"), F.explode(F.sequence(F.lit(0), F.lit(KDE_GRID - 1))).alias("point")))
    z = (lo + F.col("point") * ((hi - lo) / F.lit(float(KDE_GRID - 1))) - F.col("mean")) / F.col("bw")
    summed = points.groupBy("feature", "point").agg(F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z)).alias("s"), F.first("rows").alias("rows"), F.first("bw").alias("bw"))
    return summed.select("feature", "point", (F.col("s") / (n * F.col("bw") * F.lit(SQRT_2PI))).alias("density"))
