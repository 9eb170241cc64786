"""Profile registrations (G6 and its parts): A6 A9–A17 A24 A25 A29 P4 P12 P13 O6."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..catalog import register
from ..features.transformers import DriverFeatures
from ..functions import numeric as N
from ..operators import profile as P
from ..plans.premium import premium_dataset
from ..sources import adapter as A
from . import common as C
from .common import r6
from .features import DRIVER_SQL, PREMIUM_SQL, _sql_histogram, _sql_ratio

# --- loss summary (A16 + A12) ------------------------------------------------


def _sql_describe(src: str, col: str, name: str | None = None) -> str:
    v = f"CAST({col} AS DOUBLE)"
    return (f"SELECT {C.sql_quote(name or col)} AS feature, round(avg({v}), 6) AS mean, "
            f"round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, "
            f"round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS median, "
            f"round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max "
            f"FROM {src} WHERE {col} IS NOT NULL")


def _round_all(df, keep=("feature",)):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


LOSS_SUMMARY_SQL = A.with_sources(_sql_describe("(SELECT DISTINCT Cost_claims_year FROM claims)",
                                                "Cost_claims_year"))


@register("loss_summary", LOSS_SUMMARY_SQL)
def loss_summary(spark, sf_dir):
    losses = A.claims(spark, sf_dir).select("Cost_claims_year").dropDuplicates()
    return _round_all(P.describe(losses, ["Cost_claims_year"]))


# --- middle 95 % of losses (A11 + P10 + P8) ----------------------------------

MIDDLE95_SQL = A.with_sources("""
SELECT round(q.lo, 6) AS p_low, round(q.hi, 6) AS p_high,
       CAST(count(*) AS BIGINT) AS n_claimants,
       CAST(count(*) FILTER (WHERE t.Cost_claims_year >= q.lo AND t.Cost_claims_year <= q.hi) AS BIGINT) AS n_kept,
       round(avg(t.Cost_claims_year) FILTER (WHERE t.Cost_claims_year >= q.lo AND t.Cost_claims_year <= q.hi), 6) AS mean_kept
FROM (SELECT Cost_claims_year FROM freq_split WHERE split = 'train' AND Cost_claims_year > 0) t,
     (SELECT quantile_cont(Cost_claims_year, 0.025) AS lo, quantile_cont(Cost_claims_year, 0.975) AS hi
      FROM freq_split WHERE split = 'train' AND Cost_claims_year > 0) q
GROUP BY q.lo, q.hi
""", *C.SPLIT_CTES)


@register("loss_middle95", MIDDLE95_SQL)
def loss_middle95(spark, sf_dir):
    from ..operators.ordering import exact_quantiles
    train = C.freq_split(spark, sf_dir).where((F.col("split") == "train") & (F.col("Cost_claims_year") > 0))
    q = exact_quantiles(train, "Cost_claims_year", [0.025, 0.975], ["lo", "hi"]).select(
        F.struct("lo", "hi")).scalar()
    c = F.col("Cost_claims_year")
    kept = (c >= q.getField("lo")) & (c <= q.getField("hi"))
    return train.agg(
        r6(F.first(q.getField("lo"))).alias("p_low"), r6(F.first(q.getField("hi"))).alias("p_high"),
        F.count(F.lit(1)).cast("bigint").alias("n_claimants"),
        F.count_if(kept).cast("bigint").alias("n_kept"),
        r6(F.avg(F.when(kept, c))).alias("mean_kept"))


# --- null counts, missing patterns, duplicates (A13 A14 A15) -----------------

POLICY_COLS = [c.strip() for c in """policy_key, ID, Date_start_contract, Date_last_renewal, Date_next_renewal,
 Date_birth, Date_driving_licence, Date_lapse, Distribution_channel, Seniority, Policies_in_force,
 Max_policies, Max_products, Lapse, Payment, Premium, Cost_claims_year, N_claims_year, N_claims_history,
 R_Claims_history, Type_risk, Area, Second_driver, Year_matriculation, Power, Cylinder_capacity,
 Value_vehicle, N_doors, Type_fuel, Length, Weight""".split(",")]

NULL_PROFILE_SQL = A.with_sources("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM policies"
    for c in POLICY_COLS))


@register("null_profile", NULL_PROFILE_SQL)
def null_profile(spark, sf_dir):
    return P.null_counts(A.policies(spark, sf_dir))


MISSING_SQL = A.with_sources(
    "SELECT concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in POLICY_COLS)
    + ") AS missing_columns, CAST(count(*) AS BIGINT) AS n_rows, CAST(max("
    + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in POLICY_COLS)
    + ") AS INTEGER) AS n_missing FROM policies GROUP BY 1")


@register("missing_patterns", MISSING_SQL)
def missing_patterns(spark, sf_dir):
    return P.missing_patterns(A.policies(spark, sf_dir))


DUPLICATE_SQL = A.with_sources("""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM claims GROUP BY ID, Cost_claims_year, claim_type)""")


@register("duplicate_count", DUPLICATE_SQL)
def duplicate_count(spark, sf_dir):
    return P.duplicate_count(A.claims(spark, sf_dir).select("ID", "Cost_claims_year", "claim_type"))


# --- categories (A17 A29 O4 A6 P5) -------------------------------------------

CATEGORY_COLS = ("Distribution_channel", "Payment", "Type_risk", "Area", "Second_driver", "Type_fuel")

def _category_sql() -> str:
    body = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count, "
        f"round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM premium "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORY_COLS)
    return f"WITH premium AS ({PREMIUM_SQL})\n{body}"


@register("category_shares", _category_sql())
def category_shares(spark, sf_dir):
    prem = premium_dataset(A.policies(spark, sf_dir))
    out = P.category_shares(prem, P.text_columns(prem))   # P4: text columns by type
    return out.withColumn("percent", r6(F.col("percent")))


PAYMENT_SQL = A.with_sources("""
SELECT Payment, CAST(count(ID) AS BIGINT) AS policy_count, round(avg(Cost_claims_year), 6) AS Cost_claims_year
FROM policies GROUP BY Payment""")


@register("payment_summary", PAYMENT_SQL)
def payment_summary(spark, sf_dir):
    out = P.group_summary(A.policies(spark, sf_dir), "Payment", "ID", "Cost_claims_year")
    return out.withColumn("Cost_claims_year", r6(F.col("Cost_claims_year")))


# --- box plots and kernel density (A24 A25) ----------------------------------

BOX_COLS = ("Premium", "Value_vehicle", "Power", "Weight", "R_Claims_history")


def _sql_box(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS feature, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(q.q3 - q.q1, 6) AS iqr,
       round(min({v}) FILTER (WHERE {v} >= q.q1 - 1.5 * (q.q3 - q.q1) AND {v} <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whisker_low,
       round(max({v}) FILTER (WHERE {v} >= q.q1 - 1.5 * (q.q3 - q.q1) AND {v} <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT ({v} >= q.q1 - 1.5 * (q.q3 - q.q1) AND {v} <= q.q3 + 1.5 * (q.q3 - q.q1))) AS BIGINT) AS outliers
FROM policies, (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
                       quantile_cont({v}, 0.75) AS q3 FROM policies WHERE {c} IS NOT NULL) q
WHERE {c} IS NOT NULL GROUP BY q.q1, q.median, q.q3"""


BOX_SQL = A.with_sources("\nUNION ALL\n".join(_sql_box(c) for c in BOX_COLS))


@register("boxplot_stats", BOX_SQL)
def boxplot_stats(spark, sf_dir):
    out = P.boxplot_stats(A.policies(spark, sf_dir), BOX_COLS)
    return _round_all(out.select("feature", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high",
                                 F.col("outliers")), keep=("feature", "outliers"))


KDE_COL = "Power"

KDE_SQL = A.with_sources(f"""
SELECT CAST(g.point AS INTEGER) AS point, round(s.lo + g.point * ((s.hi - s.lo) / {float(P.KDE_GRID - 1)}), 6) AS x,
       round(sum(w.w * exp(-0.5 * power((s.lo + g.point * ((s.hi - s.lo) / {float(P.KDE_GRID - 1)}) - w.v)
                                      / (s.sd * power(CAST(s.n AS DOUBLE), -0.2)), 2)))
             / (CAST(s.n AS DOUBLE) * s.sd * power(CAST(s.n AS DOUBLE), -0.2) * {P.SQRT_2PI!r}), 10) AS density
FROM (SELECT range AS point FROM range({P.KDE_GRID})) g,
     (SELECT avg(v) AS v, count(*) AS w FROM (
        SELECT v, CASE WHEN hi > lo THEN least({P.KDE_CELLS - 1}, CAST(floor((v - lo) / ((hi - lo) / {float(P.KDE_CELLS)})) AS BIGINT)) ELSE 0 END AS cell
        FROM vals, (SELECT min(v) AS lo, max(v) AS hi FROM vals)) GROUP BY cell) w,
     (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) AS sd FROM vals) s
GROUP BY g.point, s.lo, s.hi, s.n, s.sd
""", f"vals AS (SELECT CAST({KDE_COL} AS DOUBLE) AS v FROM policies WHERE {KDE_COL} IS NOT NULL)")


@register("kde_curve", KDE_SQL)
def kde_curve(spark, sf_dir):
    out = P.kde_curve(A.policies(spark, sf_dir), KDE_COL)
    return out.select("point", r6(F.col("x")).alias("x"), F.round("density", 10).alias("density"))


# --- dispersion (A9 A10) -----------------------------------------------------

DISPERSION_SQL = A.with_sources(f"""
SELECT round(avg(y), 6) AS mean, round(var_samp(y), 6) AS variance, round(var_samp(y) / avg(y), 6) AS dispersion_ratio,
       round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, CAST(count(y) AS BIGINT) AS n_rows
FROM (SELECT CAST({C.TARGET} AS DOUBLE) AS y FROM freq_split WHERE split = 'train')""", *C.SPLIT_CTES)


@register("dispersion_check", DISPERSION_SQL)
def dispersion_check(spark, sf_dir):
    train = C.freq_split(spark, sf_dir).where(F.col("split") == "train")
    return _round_all(P.dispersion(train, C.TARGET), keep=("n_rows",))


# --- shape, types, first rows (P13 P4 P1 O6) ---------------------------------

PREMIUM_COLS = ("policy_key", "Date_birth", "Date_driving_licence", "Distribution_channel", "Payment",
                "Premium", "Type_risk", "Area", "Second_driver", "Year_matriculation", "Power",
                "Cylinder_capacity", "Value_vehicle", "N_doors", "Type_fuel", "Length", "Weight")
PREMIUM_KINDS = {c: ("date" if c.startswith("Date_") else "text" if c in CATEGORY_COLS else "numeric")
                 for c in PREMIUM_COLS}

SHAPE_SQL = f"WITH premium AS ({PREMIUM_SQL})\nSELECT CAST(count(*) AS BIGINT) AS n_rows, " \
            f"CAST({len(PREMIUM_COLS)} AS BIGINT) AS n_columns FROM premium"


@register("profile_shape", SHAPE_SQL)
def profile_shape(spark, sf_dir):
    return P.shape(premium_dataset(A.policies(spark, sf_dir)))


TYPES_SQL = f"WITH premium AS ({PREMIUM_SQL})\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {i} AS position, '{PREMIUM_KINDS[c]}' AS kind, "
    f"CAST(count({c}) AS BIGINT) AS non_null FROM premium" for i, c in enumerate(PREMIUM_COLS))


@register("column_types", TYPES_SQL)
def column_types(spark, sf_dir):
    return P.column_types(premium_dataset(A.policies(spark, sf_dir))).drop("spark_type")


FIRST_FEATURES = ("Year_matriculation", "Type_risk", "Area", "Value_vehicle", "Distribution_channel",
                  "Cylinder_capacity")

FIRST_ROWS_SQL = A.with_sources(
    f"SELECT policy_key, {', '.join(FIRST_FEATURES)}, {C.TARGET} FROM freq_ds ORDER BY policy_key LIMIT 5",
    C.FREQ_DS_CTE)


@register("first_rows", FIRST_ROWS_SQL)
def first_rows(spark, sf_dir):
    ds = C.freq_dataset(spark, sf_dir).select("policy_key", *FIRST_FEATURES, C.TARGET)
    return P.first_rows(ds, ["policy_key"], 5)


# --- G6: the whole profile in long form --------------------------------------

# P4 on the premium dataset: numeric columns other than the row key.
G6_NUMERIC = tuple(c for c, k in PREMIUM_KINDS.items() if k == "numeric" and c != "policy_key")


def _g6_sql() -> str:
    prem = f"premium AS MATERIALIZED ({PREMIUM_SQL})"
    parts = [
        "SELECT 'shape' AS section, 'rows' AS feature, 'count' AS stat, CAST(count(*) AS DOUBLE) AS value FROM premium",
        f"SELECT 'shape', 'columns', 'count', CAST({len(PREMIUM_COLS)} AS DOUBLE)",
        "SELECT 'duplicates', 'all', 'count', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) FROM "
        f"(SELECT count(*) AS n FROM premium GROUP BY {', '.join(c for c in PREMIUM_COLS if c != 'policy_key')})",
    ]
    parts += [f"SELECT 'nulls', '{c}', 'count', CAST(count(*) - count({c}) AS DOUBLE) FROM premium"
              for c in PREMIUM_COLS]
    parts.append("SELECT 'missing', concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in PREMIUM_COLS)
                 + "), 'rows', CAST(count(*) AS DOUBLE) FROM premium GROUP BY ALL")
    for c in CATEGORY_COLS:
        shares = (f"SELECT CAST({c} AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS p "
                  f"FROM premium WHERE {c} IS NOT NULL GROUP BY {c}")
        parts += [f"SELECT 'category', '{c}', 'count ' || v, n FROM ({shares})", f"SELECT 'category', '{c}', 'percent ' || v, p FROM ({shares})"]
    for c in G6_NUMERIC:
        d = f"(SELECT * FROM ({_sql_describe('premium', c)}))"
        for stat in ("mean", "std", "min", "q25", "median", "q75", "max"):
            parts.append(f"SELECT 'describe', '{c}', '{stat}', {stat} FROM {d}")
        parts.append(f"SELECT 'histogram', '{c}', 'bin ' || bin, CAST(count AS DOUBLE) FROM "
                     f"({_sql_histogram(f'SELECT CAST({c} AS DOUBLE) AS v FROM premium', P.REPORT_BINS)})")
        box = _sql_box(c).replace("FROM policies", "FROM premium")
        for stat in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers"):
            parts.append(f"SELECT 'box', '{c}', '{stat}', CAST({stat} AS DOUBLE) FROM ({box})")
        parts.append(f"SELECT 'kde', '{c}', 'point ' || point, density FROM ({_sql_kde(c)})")
    for a, b in combinations(G6_NUMERIC, 2):
        pair = f"SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM premium WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        parts.append(f"SELECT 'correlation', '{a}', '{b}', CASE WHEN var_samp(x) > 0 AND var_samp(y) > 0 "
                     f"THEN covar_samp(x, y) / sqrt(var_samp(x) * var_samp(y)) END FROM ({pair})")
    body = "\nUNION ALL\n".join(parts)
    return f"WITH {prem}\nSELECT section, feature, stat, round(value, 6) AS value FROM (\n{body})"


def _sql_kde(c: str) -> str:
    """Density of a column of ``premium`` at the points of the grid."""
    vals = f"(SELECT CAST({c} AS DOUBLE) AS v FROM premium WHERE {c} IS NOT NULL)"
    point = f"(s.lo + g.point * ((s.hi - s.lo) / {float(P.KDE_GRID - 1)}))"
    return f"""
SELECT g.point, sum(w.w * exp(-0.5 * power(({point} - w.v) / (s.sd * power(CAST(s.n AS DOUBLE), -0.2)), 2)))
       / (CAST(s.n AS DOUBLE) * s.sd * power(CAST(s.n AS DOUBLE), -0.2) * {P.SQRT_2PI!r}) AS density
FROM (SELECT range AS point FROM range({P.KDE_GRID})) g,
     (SELECT avg(v) AS v, count(*) AS w FROM (
        SELECT v, CASE WHEN hi > lo THEN least({P.KDE_CELLS - 1}, CAST(floor((v - lo) / ((hi - lo) / {float(P.KDE_CELLS)})) AS BIGINT)) ELSE 0 END AS cell
        FROM {vals}, (SELECT min(v) AS lo, max(v) AS hi FROM {vals})) GROUP BY cell) w,
     (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) AS sd FROM {vals}) s
WHERE s.sd > 0 GROUP BY g.point, s.lo, s.hi, s.n, s.sd"""


@register("report_g6", _g6_sql())
def report_g6(spark, sf_dir):
    out = P.profile_report(premium_dataset(A.policies(spark, sf_dir)), "policy_key")
    return out.withColumn("value", r6(F.col("value")))


# --- describe with infinities and NaN (F10, A12) ------------------------------

RATIO_COLS = ("driver_age_at_contract_inception", "driver_age_experience_ratio_proxy_for_driving_experience",
              "premium_per_past_claim", "cost_per_claim", "power_per_door")


def ratio_frame(spark, sf_dir):
    """Driver features with ratios that divide by zero: infinite for x / 0, NaN for 0 / 0."""
    return DriverFeatures().transform(A.policies(spark, sf_dir)).select(
        *RATIO_COLS[:2], N.ratio("Premium", "N_claims_history").alias(RATIO_COLS[2]),
        N.ratio("Cost_claims_year", "N_claims_year").alias(RATIO_COLS[3]), N.ratio("Power", "N_doors").alias(RATIO_COLS[4]))


def _sql_quantile(p: float) -> str:
    """Quantile of the sorted list ``a`` of n values, where equal neighbours may be infinite."""
    at = f"(CAST({p} AS DOUBLE) * (n - 1))"
    low, high = f"a[CAST(floor({at}) AS BIGINT) + 1]", f"a[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END"


def _ratio_sql() -> str:
    parts = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM r" for c in RATIO_COLS)
    return f"""
WITH d AS ({DRIVER_SQL}), p AS ({A.with_sources("SELECT policy_key, Premium, N_claims_history, Cost_claims_year, N_claims_year, Power, N_doors FROM policies")}),
r AS (SELECT d.{RATIO_COLS[0]}, d.{RATIO_COLS[1]}, {_sql_ratio("p.Premium", "p.N_claims_history")} AS {RATIO_COLS[2]},
             {_sql_ratio("p.Cost_claims_year", "p.N_claims_year")} AS {RATIO_COLS[3]}, {_sql_ratio("p.Power", "p.N_doors")} AS {RATIO_COLS[4]}
      FROM d JOIN p ON d.policy_key = p.policy_key),
long AS (SELECT feature, v FROM ({parts}) WHERE v IS NOT NULL AND NOT isnan(v)),
lists AS (SELECT feature, list_sort(list(v)) AS a, count(*) AS n, avg(v) AS mean, bool_or(isinf(v)) AS endless,
                 stddev_samp(CASE WHEN isfinite(v) THEN v END) AS std, min(v) AS min, max(v) AS max FROM long GROUP BY feature)
SELECT feature, round(mean, 6) AS mean, round(CASE WHEN NOT endless THEN std END, 6) AS std, round(min, 6) AS min,
       round({_sql_quantile(0.25)}, 6) AS q25, round({_sql_quantile(0.5)}, 6) AS median, round({_sql_quantile(0.75)}, 6) AS q75, round(max, 6) AS max
FROM lists"""


@register("ratio_profile", _ratio_sql())
def ratio_profile(spark, sf_dir):
    return _round_all(P.describe(ratio_frame(spark, sf_dir), RATIO_COLS))
