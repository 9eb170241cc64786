"""Extension registrations (E1, E2, E4–E6): described by the reference,
without code there; never counted as parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..features.transformers import NewClientFeatures
from ..models.baseline import MeanRegressor
from ..operators import monitoring as M
from ..sources.files import scratch_dir
from ..streaming.drift import psi_from_counts, start_drift_stream, stream_counts
from . import common as C
from .common import r6
from .features import AS_OF, _sql_date

# --- E1 pure premium ---------------------------------------------------------

PURE_SQL = C.A.with_sources(f"""
SELECT s.policy_key, round(s.prediction, 6) AS freq_pred, round(coalesce(v.sev, o.sev), 6) AS sev_pred,
       round(s.prediction * coalesce(v.sev, o.sev), 6) AS pure_premium
FROM level_scored s
LEFT JOIN (SELECT CAST({C.LEVEL_COL} AS VARCHAR) AS lvl, avg(Cost_claims_year) AS sev FROM freq_split
           WHERE split = 'train' AND Cost_claims_year > 0 GROUP BY 1) v ON CAST(s.{C.LEVEL_COL} AS VARCHAR) = v.lvl,
     (SELECT avg(Cost_claims_year) AS sev FROM freq_split WHERE split = 'train' AND Cost_claims_year > 0) o
WHERE s.split = 'test'""", *C.SCORED_CTES)


@register("pure_premium", PURE_SQL)
def pure_premium(spark, sf_dir):
    scored = C.level_scored(spark, sf_dir).withColumnRenamed("prediction", "freq_pred")
    claimants = scored.where((F.col("split") == "train") & (F.col("Cost_claims_year") > 0))
    sev = MeanRegressor(labelCol="Cost_claims_year", groupCol=C.LEVEL_COL, predictionCol="sev_pred").fit(claimants)
    out = sev.transform(scored.where(F.col("split") == "test"))
    return out.select("policy_key", r6(F.col("freq_pred")).alias("freq_pred"), r6(F.col("sev_pred")).alias("sev_pred"),
                      r6(M.pure_premium(F.col("freq_pred"), F.col("sev_pred"))).alias("pure_premium"))


# --- E2 drift ----------------------------------------------------------------

BASELINE_END = "2024-01-15"

# A segment that this variant of the query leaves without a baseline.
LATE_SEGMENT = "purchase"


def _drift_sql(events: str = "events") -> str:
    return f"""
WITH data AS (SELECT event_type AS segment, CAST(value AS DOUBLE) AS v, ts FROM {events} WHERE value IS NOT NULL),
rng AS (SELECT segment, min(v) AS lo, max(v) AS hi FROM data WHERE ts < TIMESTAMP '{BASELINE_END}' GROUP BY segment),
pooled AS (SELECT min(lo) AS lo, max(hi) AS hi FROM rng),
ranged AS (SELECT d.segment, d.v, d.ts, coalesce(r.lo, p.lo) AS lo, coalesce(r.hi, p.hi) AS hi
           FROM data d LEFT JOIN rng r ON d.segment = r.segment, pooled p),
binned AS (
  SELECT segment, ts,
         CASE WHEN hi = lo THEN 1
              ELSE least({M.PSI_BINS}, greatest(1, CAST(floor((v - lo) / ((hi - lo) / {float(M.PSI_BINS)})) AS INTEGER) + 1)) END AS bin
  FROM ranged),
base AS (SELECT segment, bin, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY segment) AS p_base
         FROM binned WHERE ts < TIMESTAMP '{BASELINE_END}' GROUP BY segment, bin),
live AS (SELECT segment, CAST(date_trunc('day', ts) AS DATE) AS window_start, bin,
                count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY segment, CAST(date_trunc('day', ts) AS DATE)) AS p_live
         FROM binned WHERE ts >= TIMESTAMP '{BASELINE_END}' GROUP BY 1, 2, 3),
grid AS (SELECT w.segment, w.window_start, b.bin
         FROM (SELECT DISTINCT segment, window_start FROM live) w
         JOIN (SELECT segment, bin FROM base UNION SELECT segment, bin FROM live) b ON w.segment = b.segment)
SELECT segment, window_start, round(sum((pl - pb) * ln(pl / pb)), 6) AS psi FROM (
  SELECT g.segment, g.window_start, greatest(coalesce(b.p_base, 0.0), {M.PSI_EPSILON!r}) AS pb,
         greatest(coalesce(l.p_live, 0.0), {M.PSI_EPSILON!r}) AS pl
  FROM grid g LEFT JOIN base b ON g.segment = b.segment AND g.bin = b.bin
  LEFT JOIN live l ON g.segment = l.segment AND g.window_start = l.window_start AND g.bin = l.bin)
GROUP BY segment, window_start"""


DRIFT_SQL = _drift_sql()


def _drift_result(psi):
    return psi.select("segment", F.col("window_start").cast("date").alias("window_start"), r6(F.col("psi")).alias("psi"))


@register("drift_psi", DRIFT_SQL)
def drift_psi(spark, sf_dir):
    ev = C.A.table(spark, sf_dir, "events")
    return _drift_result(M.drift_psi(ev, "value", "ts", "event_type", BASELINE_END))


@register("drift_late_segment", _drift_sql(
    f"(SELECT * FROM events WHERE event_type <> '{LATE_SEGMENT}' OR ts >= TIMESTAMP '{BASELINE_END}')"))
def drift_late_segment(spark, sf_dir):
    """E2 where one segment only appears after the baseline."""
    ev = C.A.table(spark, sf_dir, "events").where(
        (F.col("event_type") != LATE_SEGMENT) | (F.col("ts") >= F.lit(BASELINE_END).cast("timestamp_ntz")))
    return _drift_result(M.drift_psi(ev, "value", "ts", "event_type", BASELINE_END))


@register("drift_stream", DRIFT_SQL)
def drift_stream(spark, sf_dir):
    """E2 on a stream: the live events, written as a folder of files, are
    read as a stream to their end; every window is in the result."""
    ev = C.A.table(spark, sf_dir, "events").select("event_type", "value", "ts")
    base = (ev.where(F.col("ts") < F.lit(BASELINE_END).cast("timestamp_ntz"))
            .select(F.col("event_type").alias("segment"), F.col("value").cast("double").alias("v")).where("v is not null"))
    ranges = M.baseline_ranges(base)
    src = scratch_dir(spark, "events-in")
    (ev.where(F.col("ts") >= F.lit(BASELINE_END).cast("timestamp_ntz"))
       .withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(src))
    sink, ckpt = scratch_dir(spark, "drift-out"), scratch_dir(spark, "drift-ckpt")
    q = start_drift_stream(spark, src, ev.schema, ranges, "value", "ts", "event_type", sink, ckpt)
    q.awaitTermination()                            # ends with the input; a failure is raised here
    base_counts = (M.with_ranges(base, ranges, M.pooled_range(ranges))
                   .select("segment", M.psi_bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
                   .groupBy("segment", "bin").count())
    totals = base_counts.groupBy("segment").agg(F.sum("count").alias("_t"))
    shares = base_counts.join(totals, "segment").select("segment", "bin", (F.col("count") / F.col("_t")).alias("p_base"))
    return _drift_result(psi_from_counts(stream_counts(spark, sink), shares))


# --- E4 age bands × second driver ---------------------------------------------

def _sql_band(v: str) -> str:
    arms = " ".join(f"WHEN {v} > {M.AGE_EDGES[j]} AND {v} <= {M.AGE_EDGES[j + 1]} THEN '{M.AGE_LABELS[j]}'"
                    for j in range(len(M.AGE_LABELS)))
    return f"CASE {arms} END"


AGE_SQL = C.A.with_sources(f"""
SELECT d.band, d.band_order, f.flag, CAST(coalesce(s.policies, 0) AS BIGINT) AS policies, round(s.rate, 6) AS rate
FROM (VALUES {", ".join(f"('{lab}', {i + 1})" for i, lab in enumerate(M.AGE_LABELS))}) d(band, band_order)
CROSS JOIN (SELECT DISTINCT Second_driver AS flag FROM freq_ds WHERE Second_driver IS NOT NULL) f
LEFT JOIN (
  SELECT band, flag, count(*) AS policies, avg(t) AS rate FROM (
    SELECT {_sql_band('age')} AS band, Second_driver AS flag, CAST(claims_frequency AS DOUBLE) AS t FROM (
      SELECT *, CAST(date_diff('day', {_sql_date('Date_birth')}, DATE '{AS_OF}') AS DOUBLE) / 365.25 AS age FROM freq_ds))
  WHERE band IS NOT NULL GROUP BY band, flag) s
ON d.band = s.band AND f.flag = s.flag""", C.FREQ_DS_CTE)


@register("age_bands", AGE_SQL)
def age_bands(spark, sf_dir):
    ds = NewClientFeatures(asOf=AS_OF).transform(C.freq_dataset(spark, sf_dir))
    out = M.band_interaction(ds, "Driver_age_years", "Second_driver", C.TARGET)
    return out.withColumn("rate", r6(F.col("rate")))


# --- E5 consistency, E6 ranges ---------------------------------------------------

CONSISTENCY_SQL = C.A.with_sources("""
SELECT ID, n_rows, distinct_Value_vehicle, distinct_Type_fuel FROM (
  SELECT ID, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT Value_vehicle) AS distinct_Value_vehicle,
         count(DISTINCT Type_fuel) AS distinct_Type_fuel FROM policies GROUP BY ID)
WHERE distinct_Value_vehicle > 1 OR distinct_Type_fuel > 1""")


@register("consistency_check", CONSISTENCY_SQL)
def consistency_check(spark, sf_dir):
    out = M.inconsistent_per_key(C.A.policies(spark, sf_dir), "ID", ["Value_vehicle", "Type_fuel"])
    return out.select("ID", "n_rows", F.col("distinct_Value_vehicle").cast("bigint").alias("distinct_Value_vehicle"),
                      F.col("distinct_Type_fuel").cast("bigint").alias("distinct_Type_fuel"))


def _range_sql() -> str:
    age = f"CAST(date_diff('day', {_sql_date('Date_birth')}, DATE '{AS_OF}') AS DOUBLE) / 365.25"
    exprs = {"driver_age": age}
    parts = []
    for name, (col, lo, hi) in M.RANGE_RULES.items():
        c = exprs.get(col, col)
        conds = []
        if lo is not None:
            conds.append(f"{c} < {lo}")
        if hi is not None:
            conds.append(f"{c} > {hi}")
        parts.append(f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE {' OR '.join(conds)}) AS BIGINT) "
                     f"AS violations FROM policies")
    return C.A.with_sources("\nUNION ALL\n".join(parts))


@register("range_check", _range_sql())
def range_check(spark, sf_dir):
    pol = NewClientFeatures(asOf=AS_OF).transform(C.A.policies(spark, sf_dir))
    return M.range_violations(pol.withColumnRenamed("Driver_age_years", "driver_age"))
