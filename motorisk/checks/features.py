"""Feature, band and histogram registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..features.transformers import DriverFeatures, NewClientFeatures, VehicleFeatures
from ..functions import bands as B
from ..functions import dates as D
from ..functions.decode import PREMIUM_LABELS, sql_decode
from ..functions.numeric import log_or_null
from ..operators import histograms as H
from ..operators.dataset import modelling_dataset
from ..plans.premium import export_premium_dataset, premium_dataset
from ..sources import adapter as A
from ..sources.files import read_csv, scratch_dir
from . import common as C

AS_OF = "2018-12-31"


def _sql_date(c: str) -> str:
    return f"CAST(try_strptime({c}, '%d/%m/%Y') AS DATE)"


def _sql_ratio(num: str, den: str) -> str:
    n, d = f"CAST({num} AS DOUBLE)", f"CAST({den} AS DOUBLE)"
    return (f"CASE WHEN {d} = 0 THEN (CASE WHEN {n} = 0 THEN CAST('nan' AS DOUBLE) "
            f"WHEN {n} > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END) "
            f"ELSE {n} / {d} END")


DATE_COLS = ("Date_start_contract", "Date_last_renewal", "Date_next_renewal", "Date_birth",
             "Date_driving_licence", "Date_lapse")

DRIVER_SQL = A.with_sources("""
SELECT policy_key, """ + ", ".join(DATE_COLS) + """, renewal_year,
       age AS driver_age_at_contract_inception, exp AS driver_experience_age, driver_age_at_contract_start,
       CAST(abs(age - exp) AS INTEGER) AS driver_age_experience_age_diff,
       """ + _sql_ratio("abs(age - exp)", "age") + """ AS driver_age_experience_ratio_proxy_for_driving_experience
FROM (
  SELECT policy_key, """ + ", ".join(DATE_COLS) + """,
         CAST(year(Date_last_renewal) AS INTEGER) AS renewal_year,
         CAST(abs(year(Date_last_renewal) - year(Date_birth)) AS INTEGER) AS age,
         CAST(abs(year(Date_last_renewal) - year(Date_driving_licence)) AS INTEGER) AS exp,
         CAST(year(Date_last_renewal) - year(Date_birth) AS INTEGER) AS driver_age_at_contract_start
  FROM (SELECT policy_key, """ + ", ".join(f"{_sql_date(c)} AS {c}" for c in DATE_COLS) + """ FROM policies))
""")


@register("driver_features", DRIVER_SQL)
def driver_features(spark, sf_dir):
    df = DriverFeatures().transform(A.policies(spark, sf_dir))
    return df.select(
        "policy_key", *DATE_COLS,
        F.year("Date_last_renewal").alias("renewal_year"),
        "driver_age_at_contract_inception", "driver_experience_age",
        D.signed_year_difference("Date_last_renewal", "Date_birth").alias("driver_age_at_contract_start"),
        "driver_age_experience_age_diff",
        "driver_age_experience_ratio_proxy_for_driving_experience",
    )


NEW_CLIENT_SQL = A.with_sources(f"""
SELECT policy_key, Date_birth_dt, Date_driving_licence_dt, power_to_weight, Car_age_years, Type_fuel_encoded,
       CAST(date_diff('day', Date_birth_dt, DATE '{AS_OF}') AS DOUBLE) / 365.25 AS Driver_age_years,
       CAST(date_diff('day', Date_driving_licence_dt, DATE '{AS_OF}') AS DOUBLE) / 365.25 AS Driver_experience_years
FROM (
  SELECT policy_key, {_sql_date('Date_birth')} AS Date_birth_dt,
         {_sql_date('Date_driving_licence')} AS Date_driving_licence_dt,
         {_sql_ratio('Power', 'Weight')} AS power_to_weight,
         CAST(abs(Year_matriculation - {AS_OF[:4]}) AS INTEGER) AS Car_age_years,
         CAST(CASE WHEN Type_fuel = 'P' THEN 0 WHEN Type_fuel = 'D' THEN 1 END AS INTEGER) AS Type_fuel_encoded
  FROM policies)
""")


@register("new_client_features", NEW_CLIENT_SQL)
def new_client_features(spark, sf_dir):
    df = NewClientFeatures(asOf=AS_OF).transform(A.policies(spark, sf_dir))
    return df.select("policy_key", "Date_birth_dt", "Date_driving_licence_dt", "power_to_weight",
                     "Car_age_years", "Type_fuel_encoded", "Driver_age_years", "Driver_experience_years")


VEHICLE_SQL = A.with_sources("""
SELECT p.policy_key, CAST(coalesce(l.code, -1) AS INTEGER) AS fuel_type_encoded,
       round(ln(p.Value_vehicle), 9) AS Value_vehicle_log_transformed,
       round(CASE WHEN p.Premium - 1000 > 0 THEN ln(p.Premium - 1000) END, 9) AS premium_excess_log
FROM policies p LEFT JOIN (
  SELECT Type_fuel, row_number() OVER (ORDER BY min(policy_key), Type_fuel) - 1 AS code
  FROM policies WHERE Type_fuel IS NOT NULL GROUP BY Type_fuel) l
ON p.Type_fuel = l.Type_fuel
""")


@register("vehicle_features", VEHICLE_SQL)
def vehicle_features(spark, sf_dir):
    pol = A.policies(spark, sf_dir)
    model = VehicleFeatures().fit(pol)
    model.validate(pol)
    out = model.transform(pol)
    return out.select("policy_key", "fuel_type_encoded",
                      F.round("Value_vehicle_log_transformed", 9).alias("Value_vehicle_log_transformed"),
                      F.round(log_or_null(F.col("Premium") - 1000), 9).alias("premium_excess_log"))


_KEEP = ("policy_key", "Date_birth", "Date_driving_licence", "Distribution_channel", "Payment",
         "Premium", "Type_risk", "Area", "Second_driver", "Year_matriculation", "Power",
         "Cylinder_capacity", "Value_vehicle", "N_doors", "Type_fuel", "Length", "Weight")


def _premium_sql_col(c: str) -> str:
    if c in PREMIUM_LABELS:
        return f"{sql_decode(c, PREMIUM_LABELS[c])} AS {c}"
    if c.startswith("Date_"):
        return f"{_sql_date(c)} AS {c}"
    return c


PREMIUM_SQL = A.with_sources("SELECT " + ", ".join(_premium_sql_col(c) for c in _KEEP) + " FROM policies")


@register("premium_dataset", PREMIUM_SQL)
def premium(spark, sf_dir):
    return premium_dataset(A.policies(spark, sf_dir))


@register("premium_export", PREMIUM_SQL)
def premium_export(spark, sf_dir):
    """S3 + S2: the dataset written as comma text with a header and read back
    with its schema."""
    policies = A.policies(spark, sf_dir)
    path = scratch_dir(spark, "premium-csv")
    export_premium_dataset(policies, path)
    return read_csv(spark, path, premium_dataset(policies).schema)


FLAG_DATASET_CTE = """
flag_ds AS (
  SELECT p.*, coalesce(f.cost, 0.0) AS claim_cost,
         CAST(coalesce(f.cost, 0.0) > 0 AS INTEGER) AS claims_frequency
  FROM policies p LEFT JOIN (
    SELECT ID, Cost_claims_year, coalesce(sum(Cost_claims_by_type), 0.0) AS cost
    FROM claims WHERE ID IS NOT NULL AND Cost_claims_year IS NOT NULL
    GROUP BY ID, Cost_claims_year) f
  ON p.ID = f.ID AND p.Cost_claims_year = f.Cost_claims_year)"""


def _sql_band(v: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {v} > {edges[j]} AND {v} <= {edges[j + 1]} THEN '{labels[j]}'"
                    for j in range(len(labels)))
    return f"CASE {arms} END"


EXPERIENCE_SQL = A.with_sources(f"""
SELECT d.band, d.band_order, round(s.rate, 4) AS claims_rate,
       CAST(coalesce(s.cnt, 0) AS BIGINT) AS count, CAST(coalesce(s.total, 0) AS BIGINT) AS total_claims,
       round((SELECT avg(claims_frequency) FROM flag_ds), 4) AS base_rate,
       round(s.rate / (SELECT avg(claims_frequency) FROM flag_ds), 4) AS lift
FROM (VALUES {", ".join(f"('{lab}', {i + 1})" for i, lab in enumerate(B.EXPERIENCE_LABELS))}) d(band, band_order)
LEFT JOIN (
  SELECT band, avg(claims_frequency) AS rate, count(claims_frequency) AS cnt, sum(claims_frequency) AS total
  FROM (SELECT {_sql_band('x', B.EXPERIENCE_EDGES, B.EXPERIENCE_LABELS)} AS band, claims_frequency
        FROM (SELECT CAST(date_diff('day', {_sql_date('Date_driving_licence')}, DATE '{AS_OF}') AS DOUBLE) / 365.25 AS x,
                     claims_frequency FROM flag_ds))
  WHERE band IS NOT NULL GROUP BY band) s
ON d.band = s.band
""", FLAG_DATASET_CTE)


def _flag_dataset(spark, sf_dir):
    return modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "flag")


@register("experience_bands", EXPERIENCE_SQL)
def experience_bands(spark, sf_dir):
    ds = NewClientFeatures(asOf=AS_OF).transform(_flag_dataset(spark, sf_dir))
    return H.band_table(ds, "Driver_experience_years", "claims_frequency")


def _sql_cut_counts(src: str, col: str, k: int) -> str:
    w = f"((s.hi - s.lo) / {float(k)})"
    return f"""
SELECT d.bin,
       round(CASE WHEN d.bin = 1 THEN s.lo - (s.hi - s.lo) * {B.CUT_LOW_EDGE_WIDEN} ELSE s.lo + (d.bin - 1) * {w} END, 6) AS lo,
       round(CASE WHEN d.bin = {k} THEN s.hi ELSE s.lo + d.bin * {w} END, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range + 1 AS INTEGER) AS bin FROM range({k})) d
CROSS JOIN (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src}) s
LEFT JOIN (
  SELECT bin, count(*) AS n FROM (
    SELECT CASE WHEN s2.hi = s2.lo THEN 1
                ELSE least({k}, greatest(1, CAST(ceil((CAST({col} AS DOUBLE) - s2.lo) / ((s2.hi - s2.lo) / {float(k)})) AS INTEGER))) END AS bin
    FROM {src}, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src}) s2
    WHERE {col} IS NOT NULL) GROUP BY bin) c
ON d.bin = c.bin"""


WEIGHT_HIST_SQL = A.with_sources(_sql_cut_counts("policies", "Weight", 10))


@register("weight_histogram", WEIGHT_HIST_SQL)
def weight_histogram(spark, sf_dir):
    return H.cut_counts(A.policies(spark, sf_dir), "Weight", 10)


WEIGHT_BANDS_SQL = A.with_sources("""
SELECT policy_key, Weight,
       CASE WHEN Weight IS NULL THEN NULL WHEN s.hi = s.lo THEN 1
            ELSE least(10, greatest(1, CAST(ceil((Weight - s.lo) / ((s.hi - s.lo) / 10.0)) AS INTEGER))) END AS binned_Weight
FROM policies, (SELECT CAST(min(Weight) AS DOUBLE) AS lo, CAST(max(Weight) AS DOUBLE) AS hi FROM policies) s
""")


@register("weight_bands", WEIGHT_BANDS_SQL)
def weight_bands(spark, sf_dir):
    df = A.policies(spark, sf_dir).select("policy_key", "Weight")
    return H.with_cut_column(df, "Weight", 10)


def _sql_histogram(src_values: str, k: int) -> str:
    """A21 over a CTE-less subquery yielding column v."""
    rng = (f"(SELECT CASE WHEN max(v) = min(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, "
           f"CASE WHEN max(v) = min(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM ({src_values}))")
    w = f"((s.hi - s.lo) / {float(k)})"
    return f"""
SELECT d.bin, round(s.lo + (d.bin - 1) * {w}, 6) AS lo,
       round(CASE WHEN d.bin = {k} THEN s.hi ELSE s.lo + d.bin * {w} END, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range + 1 AS INTEGER) AS bin FROM range({k})) d
CROSS JOIN {rng} s
LEFT JOIN (
  SELECT bin, count(*) AS n FROM (
    SELECT CASE WHEN v >= s.lo AND v <= s.hi
                THEN least({k}, CAST(floor((v - s.lo) / {w}) + 1 AS INTEGER)) END AS bin
    FROM ({src_values}), {rng} s) WHERE bin IS NOT NULL GROUP BY bin) c
ON d.bin = c.bin"""


LOG_LOSS_SQL = A.with_sources(_sql_histogram(
    "SELECT ln(Cost_claims_year) AS v FROM (SELECT DISTINCT Cost_claims_year FROM claims) "
    "WHERE Cost_claims_year > 0", 10))


@register("log_loss_histogram", LOG_LOSS_SQL)
def log_loss_histogram(spark, sf_dir):
    losses = A.claims(spark, sf_dir).select("Cost_claims_year").dropDuplicates()
    return H.histogram(losses.where(F.col("Cost_claims_year") > 0), k=10,
                       expr=F.ln("Cost_claims_year"))


OBSERVED_EDGES = B.linspace(-1, 30, 20)


def _sql_fixed_bins(v: str, edges) -> str:
    n = len(edges) - 1
    arms = []
    for j in range(n):
        hi_op = "<=" if j == n - 1 else "<"
        arms.append(f"WHEN {v} >= CAST('{edges[j]!r}' AS DOUBLE) AND {v} {hi_op} CAST('{edges[j + 1]!r}' AS DOUBLE) THEN {j + 1}")
    return "CASE " + " ".join(arms) + " END"


def _sql_edge_dim(edges) -> str:
    rows = ", ".join(f"({j + 1}, CAST('{edges[j]!r}' AS DOUBLE), CAST('{edges[j + 1]!r}' AS DOUBLE))"
                     for j in range(len(edges) - 1))
    return f"(VALUES {rows}) d(bin, lo, hi)"


FIXED_EDGE_SQL = A.with_sources(f"""
SELECT CAST(d.bin AS INTEGER) AS bin, round(d.lo, 6) AS lo, round(d.hi, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM {_sql_edge_dim(OBSERVED_EDGES)}
LEFT JOIN (SELECT bin, count(*) AS n FROM (
  SELECT {_sql_fixed_bins('CAST(claims_frequency AS DOUBLE)', OBSERVED_EDGES)} AS bin FROM freq_ds)
  WHERE bin IS NOT NULL GROUP BY bin) c ON d.bin = c.bin
""", """
freq_ds AS (
  SELECT p.policy_key, coalesce(f.n, 0) AS claims_frequency
  FROM policies p LEFT JOIN (
    SELECT ID, Cost_claims_year, count(Cost_claims_by_type) AS n FROM claims
    WHERE ID IS NOT NULL AND Cost_claims_year IS NOT NULL GROUP BY ID, Cost_claims_year) f
  ON p.ID = f.ID AND p.Cost_claims_year = f.Cost_claims_year)""")


@register("fixed_edge_histogram", FIXED_EDGE_SQL)
def fixed_edge_histogram(spark, sf_dir):
    ds = modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "count")
    return H.fixed_edge_histogram(ds, "claims_frequency", OBSERVED_EDGES)


# --- A21 on the target (4 bins, training split) and A22 on predictions --------

def _target_histogram_sql() -> str:
    return A.with_sources(_sql_histogram(
        f"SELECT CAST({C.TARGET} AS DOUBLE) AS v FROM freq_split WHERE split = 'train'", 4), *C.SPLIT_CTES)


@register("target_histogram", _target_histogram_sql())
def target_histogram(spark, sf_dir):
    train = C.freq_split(spark, sf_dir).where(F.col("split") == "train")
    return H.histogram(train, C.TARGET, 4)


PREDICTED_EDGES = B.linspace(-1, 4, 20)


def _predicted_histogram_sql() -> str:
    return A.with_sources(f"""
SELECT s.split, CAST(d.bin AS INTEGER) AS bin, round(d.lo, 6) AS lo, round(d.hi, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM {_sql_edge_dim(PREDICTED_EDGES)}
CROSS JOIN (SELECT DISTINCT split FROM level_scored) s
LEFT JOIN (SELECT split, bin, count(*) AS n FROM (
  SELECT split, {_sql_fixed_bins('prediction', PREDICTED_EDGES)} AS bin FROM level_scored)
  WHERE bin IS NOT NULL GROUP BY split, bin) c ON d.bin = c.bin AND s.split = c.split
""", *C.SCORED_CTES)


@register("predicted_histogram", _predicted_histogram_sql())
def predicted_histogram(spark, sf_dir):
    """Predictions of the level-mean model per split on the
    reference's edges linspace(-1, 4, 20); empty bins kept."""
    return H.fixed_edge_histogram(C.level_scored(spark, sf_dir), "prediction", PREDICTED_EDGES, ["split"])
