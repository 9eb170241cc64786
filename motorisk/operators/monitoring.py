"""Extensions described by the reference without code.

* E1 pure premium: frequency prediction × severity prediction.
* E2 drift: population stability index of a value's distribution in each
  event-time window against a baseline period, per segment. Bins are equal
  width over the baseline range (outside values go to the end bins); shares
  are floored at a small epsilon so empty bins stay finite. Batch form here;
  ``streaming.drift`` runs the same windows on a stream with a watermark.
* E4 banding with a second-driver interaction.
* E5 values that should be constant per client but are not.
* E6 range rules counted in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B

PSI_BINS = 10
PSI_EPSILON = 1e-6

# Driver-age bands (years, right-closed) used with the second-driver flag.
AGE_EDGES = (17, 25, 35, 50, 65, 120)
AGE_LABELS = ("18-25", "26-35", "36-50", "51-65", "65+")

# Plausibility rules (lower, upper) of the data checks.
RANGE_RULES = {
    "weight_500_2500": ("Weight", 500, 2500),
    "driver_age_18_80": ("driver_age", 18, 80),
    "n_claims_year_non_negative": ("N_claims_year", 0, None),
    "n_claims_history_non_negative": ("N_claims_history", 0, None),
    "premium_non_negative": ("Premium", 0, None),
}


def pure_premium(freq: Column, sev: Column) -> Column:
    return freq * sev


def psi_bin(value: Column, lo: Column, hi: Column, k: int = PSI_BINS) -> Column:
    w = (hi - lo) / F.lit(float(k))
    raw = F.floor((value - lo) / w).cast("int") + 1
    return F.when((hi == lo) | lo.isNull(), F.lit(1)).otherwise(F.least(F.lit(k), F.greatest(F.lit(1), raw)))


def baseline_ranges(base: DataFrame) -> DataFrame:
    """Value range of every segment (columns segment, v) of the baseline."""
    return base.groupBy("segment").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def pooled_range(ranges: DataFrame) -> tuple[float | None, float | None]:
    return tuple(ranges.agg(F.min("lo"), F.max("hi")).first())


def with_ranges(rows: DataFrame, ranges: DataFrame, pooled: tuple) -> DataFrame:
    """Rows with the baseline range of their segment. A segment without a
    baseline gets the pooled range, so it is reported, not lost; its baseline
    shares are all empty."""
    lo, hi = (F.lit(x).cast("double") for x in pooled)
    known = ranges.select(F.col("segment").alias("_segment"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return (rows.join(known, F.col("segment") == F.col("_segment"), "left")
            .withColumns({"lo": F.coalesce("_lo", lo), "hi": F.coalesce("_hi", hi)}).drop("_segment", "_lo", "_hi"))


def drift_psi(df: DataFrame, value: str, ts: str, segment: str, baseline_end: str,
              window: str = "1 day", k: int = PSI_BINS) -> DataFrame:
    """PSI per (segment, window) of the rows at or after ``baseline_end``
    against the rows before it."""
    v, t = F.col(value).cast("double"), F.col(ts)
    data = df.select(F.col(segment).alias("segment"), v.alias("v"), t.alias("ts")).where(F.col("v").isNotNull())
    base = data.where(F.col("ts") < F.lit(baseline_end).cast("timestamp_ntz"))
    live = data.where(F.col("ts") >= F.lit(baseline_end).cast("timestamp_ntz"))
    rng = baseline_ranges(base)
    bins = F.col("bin")

    def shares(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        counted = (with_ranges(frame, rng, pooled_range(rng)).select(*keys, psi_bin(F.col("v"), F.col("lo"), F.col("hi"), k).alias("bin"))
                   .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
        totals = counted.groupBy(*keys).agg(F.sum("n").alias("_t"))
        return counted.join(totals, list(keys)).select(*keys, bins, (F.col("n") / F.col("_t")).alias("share"))

    base_sh = shares(base, ["segment"]).withColumnRenamed("share", "p_base")
    windowed = live.withColumn("window_start", F.window("ts", window).start)
    live_sh = shares(windowed, ["segment", "window_start"]).withColumnRenamed("share", "p_live")
    grid = (live_sh.select("segment", "window_start").distinct()
            .join(base_sh.select("segment", "bin").unionByName(live_sh.select("segment", "bin")).distinct(),
                  "segment"))
    full = (grid.join(base_sh, ["segment", "bin"], "left").join(live_sh, ["segment", "window_start", "bin"], "left")
            .select("segment", "window_start",
                    F.greatest(F.coalesce("p_base", F.lit(0.0)), F.lit(PSI_EPSILON)).alias("pb"),
                    F.greatest(F.coalesce("p_live", F.lit(0.0)), F.lit(PSI_EPSILON)).alias("pl")))
    return full.groupBy("segment", "window_start").agg(
        F.sum((F.col("pl") - F.col("pb")) * F.ln(F.col("pl") / F.col("pb"))).alias("psi"))


def band_interaction(df: DataFrame, value: str, flag: str, target: str,
                     edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS) -> DataFrame:
    """Policies and mean target per (band, flag); every band × flag kept."""
    banded = df.select(B.right_closed_band(value, edges, labels).alias("band"),
                       F.col(flag).alias("flag"), F.col(target).cast("double").alias("t"))
    stats = banded.where(F.col("band").isNotNull()).groupBy("band", "flag").agg(
        F.count(F.lit(1)).alias("policies"), F.avg("t").alias("rate"))
    # every flag level with every band: the bands are literals
    bands = F.array(*[F.struct(F.lit(lab).alias("band"), F.lit(i + 1).alias("band_order")) for i, lab in enumerate(labels)])
    flags = banded.select("flag").where(F.col("flag").isNotNull()).distinct()
    return flags.select("flag", F.inline(bands)).join(
        stats, ["band", "flag"], "left").select(
        "band", "band_order", "flag", F.coalesce("policies", F.lit(0)).cast("bigint").alias("policies"),
        F.col("rate"))


def inconsistent_per_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """E5: keys where a column that should be constant takes several values."""
    aggs = [F.count_distinct(c).alias(f"distinct_{c}") for c in columns]
    per = df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), *aggs)
    cond = F.lit(False)
    for c in columns:
        cond = cond | (F.col(f"distinct_{c}") > 1)
    return per.where(cond)


def range_violations(df: DataFrame, rules: Mapping[str, tuple] = RANGE_RULES) -> DataFrame:
    """Rows breaking each rule (NULL is not a violation), one pass."""
    aggs = []
    for name, (col, lo, hi) in rules.items():
        c = F.col(col)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (c < lo)
        if hi is not None:
            bad = bad | (c > hi)
        aggs.append(F.count_if(F.coalesce(bad, F.lit(False))).cast("bigint").alias(name))
    wide = df.agg(*aggs)
    return wide.unpivot([], list(rules), "rule", "violations")
