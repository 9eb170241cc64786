"""Split, correlation and evaluation registrations: X1–X3, A18–A20, A26–A28,
A30, M5, M9, M11."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from ..catalog import register
from ..features.transformers import DriverFeatures, VehicleFeatures
from ..functions import dates as D
from ..functions import numeric as N
from ..models.baseline import MeanRegressor
from ..models.glm import select_training_algorithm
from ..operators import correlation as R
from ..operators import evaluation as E
from ..operators import splits as S
from ..operators.materialize import materialize
from ..plans import runs as RUN
from ..sources import adapter as A
from . import common as C
from .common import r6

# --- splits (X1 X2 X3) -------------------------------------------------------

SPLIT_RANDOM_SQL = A.with_sources("SELECT policy_key, split FROM freq_split", *C.SPLIT_CTES)


@register("split_random", SPLIT_RANDOM_SQL)
def split_random(spark, sf_dir):
    return C.freq_split(spark, sf_dir).select("policy_key", "split")


SPLIT_ORDERED_SQL = A.with_sources("""
SELECT policy_key, renewal,
       CASE WHEN row_number() OVER (ORDER BY renewal ASC NULLS FIRST, policy_key) - 1
                 < (SELECT CAST(floor(count(*) * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT) FROM policies)
            THEN 'train' ELSE 'test' END AS split
FROM (SELECT policy_key, CAST(try_strptime(Date_last_renewal, '%d/%m/%Y') AS DATE) AS renewal FROM policies)""")


@register("split_ordered", SPLIT_ORDERED_SQL)
def split_ordered(spark, sf_dir):
    pol = A.policies(spark, sf_dir).select("policy_key", D.parse_date("Date_last_renewal").alias("renewal"))
    return S.split_ordered(pol, ["renewal"], "policy_key", C.TEST_RATIO)


SHUFFLE_SQL = A.with_sources(f"""
SELECT policy_key, row_number() OVER (ORDER BY md5(CAST(policy_key AS VARCHAR) || '{C.SEED}'), policy_key) - 1
       AS shuffle_position FROM policies""")


@register("shuffle_order", SHUFFLE_SQL)
def shuffle_order(spark, sf_dir):
    return S.shuffle_order(A.policies(spark, sf_dir).select("policy_key"), "policy_key", C.SEED)


# --- correlation (A18 A19 A20) -----------------------------------------------

def _sql_clean(c: str) -> str:
    return f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"


def _sql_corr(x: str, y: str) -> str:
    return (f"round(CASE WHEN var_samp({x}) > 0 AND var_samp({y}) > 0 "
            f"THEN covar_samp({x}, {y}) / sqrt(var_samp({x}) * var_samp({y})) END, 6)")


def _sql_pearson(src: str, cols) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        inner = (f"SELECT {_sql_clean(a)} AS x, {_sql_clean(b)} AS y FROM {src}")
        sel = f"{_sql_corr('x', 'y')} AS corr FROM ({inner}) WHERE x IS NOT NULL AND y IS NOT NULL"
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sel}")
        parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {sel}")
    for c in cols:
        parts.append(f"SELECT '{c}', '{c}', CASE WHEN var_samp({_sql_clean(c)}) > 0 THEN 1.0 END FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _sql_spearman_pair(src: str, a: str, b: str, first: str = "col_a", second: str = "col_b") -> str:
    ranks = ("SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
             "rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry "
             f"FROM (SELECT {_sql_clean(a)} AS x, {_sql_clean(b)} AS y FROM {src}) "
             "WHERE x IS NOT NULL AND y IS NOT NULL")
    return f"SELECT '{a}' AS {first}, '{b}' AS {second}, {_sql_corr('rx', 'ry')} AS corr FROM ({ranks})"


def _sql_spearman(src: str, cols) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(_sql_spearman_pair(src, a, b))
        parts.append(_sql_spearman_pair(src, b, a))
    for c in cols:
        parts.append(f"SELECT '{c}', '{c}', CASE WHEN var_samp({_sql_clean(c)}) > 0 THEN 1.0 END FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _rounded_corr(df):
    return df.withColumn("corr", r6(F.col("corr")))


PEARSON_COLS = ("claims_frequency", "Premium", "Value_vehicle", "Power", "Weight", "Length", "Payment", "Lapse")
PEARSON_SQL = A.with_sources(_sql_pearson("freq_ds", PEARSON_COLS), C.FREQ_DS_CTE)


@register("pearson_matrix", PEARSON_SQL)
def pearson_matrix(spark, sf_dir):
    return _rounded_corr(R.pearson_matrix(C.freq_dataset(spark, sf_dir), PEARSON_COLS))


SPEARMAN_COLS = ("ID", "claims_frequency", "N_claims_year", "R_Claims_history", "N_claims_history", "Weight")
SPEARMAN_SQL = A.with_sources(_sql_spearman("freq_ds", SPEARMAN_COLS), C.FREQ_DS_CTE)


@register("spearman_matrix", SPEARMAN_SQL)
def spearman_matrix(spark, sf_dir):
    return _rounded_corr(R.spearman_matrix(C.freq_dataset(spark, sf_dir), "policy_key", SPEARMAN_COLS))


SCREEN_FEATURES = (
    "driver_age_at_contract_start", "driver_experience_age", "driver_age_experience_age_diff",
    "driver_age_experience_ratio_proxy_for_driving_experience", "lapse_flag", "Payment",
    "R_Claims_history", "fuel_type_encoded", "Value_vehicle_log_transformed", "N_doors", "Length",
    "Cylinder_capacity", "Power",
)

ENGINEERED_CTE = """
engineered AS (
  SELECT e.*, abs(age - exp) AS driver_age_experience_age_diff,
         CASE WHEN age = 0 THEN (CASE WHEN abs(age - exp) = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END)
              ELSE CAST(abs(age - exp) AS DOUBLE) / age END AS driver_age_experience_ratio_proxy_for_driving_experience
  FROM (
    SELECT f.policy_key, f.claims_frequency, f.Payment, f.R_Claims_history, f.N_doors, f.Length,
           f.Cylinder_capacity, f.Power,
           year(r) - year(b) AS driver_age_at_contract_start,
           abs(year(r) - year(b)) AS age, abs(year(r) - year(l)) AS exp,
           abs(year(r) - year(l)) AS driver_experience_age,
           CAST(coalesce(f.Lapse >= 1, false) AS INTEGER) AS lapse_flag,
           coalesce(lv.code, -1) AS fuel_type_encoded,
           ln(f.Value_vehicle) AS Value_vehicle_log_transformed
    FROM (SELECT *, CAST(try_strptime(Date_last_renewal, '%d/%m/%Y') AS DATE) AS r,
                 CAST(try_strptime(Date_birth, '%d/%m/%Y') AS DATE) AS b,
                 CAST(try_strptime(Date_driving_licence, '%d/%m/%Y') AS DATE) AS l FROM freq_ds) f
    LEFT JOIN (SELECT Type_fuel, row_number() OVER (ORDER BY min(policy_key), Type_fuel) - 1 AS code
               FROM freq_ds WHERE Type_fuel IS NOT NULL GROUP BY Type_fuel) lv
    ON f.Type_fuel = lv.Type_fuel) e)"""


def _screen_sql() -> str:
    parts = [_sql_spearman_pair("engineered", C.TARGET, f, "target", "feature") for f in SCREEN_FEATURES]
    body = "\nUNION ALL\n".join(parts)
    own = (f"SELECT '{C.TARGET}' AS feature, CASE WHEN var_samp(CAST({C.TARGET} AS DOUBLE)) > 0 "
           f"THEN 1.0 END AS corr FROM engineered")
    return A.with_sources(f"SELECT feature, corr FROM ({body})\nUNION ALL\n{own}",
                          C.FREQ_DS_CTE, ENGINEERED_CTE)


def engineered_frame(spark, sf_dir):
    """Features of the renewal screening table."""
    ds = C.freq_dataset(spark, sf_dir)
    ds = DriverFeatures().transform(ds).withColumns({
        "driver_age_at_contract_start": D.signed_year_difference("Date_last_renewal", "Date_birth"),
        "lapse_flag": N.flag_at_least("Lapse", 1),
    })
    return VehicleFeatures().fit(ds).transform(ds)


@register("feature_screen", _screen_sql())
def feature_screen(spark, sf_dir):
    out = R.feature_screen(engineered_frame(spark, sf_dir), "policy_key", C.TARGET, SCREEN_FEATURES)
    return _rounded_corr(out)


# --- metrics and calibration (M5 M9 M11 A26 A27 A28 A30) ---------------------

def _sql_metrics(y: str, mu: str) -> str:
    e2 = f"(({y}) - ({mu})) * (({y}) - ({mu}))"
    return f"""CAST(count(*) AS BIGINT) AS n, round(avg({e2}), 6) AS mse, round(sqrt(avg({e2})), 6) AS rmse,
       round(avg(abs({y} - {mu})), 6) AS mae,
       round(CASE WHEN var_pop({y}) > 0 THEN 1 - sum({e2}) / (count(*) * var_pop({y}))
                  WHEN sum({e2}) = 0 THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS r2,
       round(quantile_cont(abs({y} - {mu}), 0.5), 6) AS medae,
       round(avg(CASE WHEN {mu} > 0 THEN 2 * ((CASE WHEN {y} = 0 THEN 0.0 ELSE {y} * ln({y} / {mu}) END) - {y} + {mu}) END), 6)
         AS poisson_deviance,
       CAST(count(*) FILTER (WHERE NOT ({mu} > 0)) AS BIGINT) AS non_positive_predictions"""


BASELINE_SQL = A.with_sources(f"""
SELECT model, split, {_sql_metrics('y', 'mu')}
FROM (
  SELECT split, CAST({C.TARGET} AS DOUBLE) AS y, 'mean' AS model,
         (SELECT avg(CAST({C.TARGET} AS DOUBLE)) FROM freq_split WHERE split = 'train') AS mu FROM level_scored
  UNION ALL
  SELECT split, CAST({C.TARGET} AS DOUBLE), 'level_mean', prediction FROM level_scored)
GROUP BY model, split""", *C.SCORED_CTES)


def _round_metrics(df, keep):
    return df.select(*keep, "n", *[r6(F.col(m)).alias(m) for m in E.METRICS], "non_positive_predictions")


@register("baseline_metrics", BASELINE_SQL)
def baseline_metrics(spark, sf_dir):
    scored = C.level_scored(spark, sf_dir).withColumnRenamed("prediction", "level_mean")
    train = scored.where(F.col("split") == "train")
    mean_model = MeanRegressor(labelCol=C.TARGET, predictionCol="mean").fit(train)
    both = mean_model.transform(scored)
    long = E.long_scores(both, ["mean", "level_mean"], ["split", C.TARGET])
    return _round_metrics(E.regression_metrics(long, C.TARGET, group_cols=["model", "split"]), ["model", "split"])


CALIBRATION_SQL = A.with_sources(f"""
SELECT CAST(bin AS INTEGER) AS bin, round(avg(y), 6) AS y_true_mean, round(avg(prediction), 6) AS y_pred_mean,
       CAST(count(*) AS BIGINT) AS n_rows, round((bin + 0.5) / 10, 6) AS bin_center
FROM (
  SELECT *, CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1)
                 ELSE (n % 10) + (i - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS bin
  FROM (SELECT CAST({C.TARGET} AS DOUBLE) AS y, prediction,
               row_number() OVER (ORDER BY prediction, policy_key) - 1 AS i, count(*) OVER () AS n
        FROM level_scored WHERE split = 'test'))
GROUP BY bin""", *C.SCORED_CTES)


@register("risk_calibration", CALIBRATION_SQL)
def risk_calibration(spark, sf_dir):
    test = C.level_scored(spark, sf_dir).where(F.col("split") == "test")
    out = E.risk_group_calibration(test, C.TARGET, "prediction", "policy_key", 10)
    return out.select("bin", r6(F.col("y_true_mean")).alias("y_true_mean"),
                      r6(F.col("y_pred_mean")).alias("y_pred_mean"), "n_rows",
                      r6(F.col("bin_center")).alias("bin_center"))


OBS_FEATURE = "Area"

OBS_PRED_SQL = A.with_sources(f"""
SELECT {OBS_FEATURE}, round(sum(CAST({C.TARGET} AS DOUBLE)), 6) AS observed, round(sum(prediction), 6) AS predicted
FROM level_scored WHERE split = 'test' GROUP BY {OBS_FEATURE}""", *C.SCORED_CTES)


@register("observed_vs_predicted", OBS_PRED_SQL)
def observed_vs_predicted(spark, sf_dir):
    test = C.level_scored(spark, sf_dir).where(F.col("split") == "test")
    out = E.observed_vs_predicted(test, OBS_FEATURE, C.TARGET, "prediction")
    return out.select(OBS_FEATURE, r6(F.col("observed")).alias("observed"), r6(F.col("predicted")).alias("predicted"))


BALANCE_SQL = A.with_sources(f"""
SELECT split, round(sum(CAST({C.TARGET} AS DOUBLE)), 6) AS actual_total, round(sum(prediction), 6) AS predicted_total
FROM level_scored GROUP BY split""", *C.SCORED_CTES)


@register("portfolio_balance", BALANCE_SQL)
def portfolio_balance(spark, sf_dir):
    out = E.portfolio_balance(C.level_scored(spark, sf_dir), C.TARGET, "prediction", ["split"])
    return out.select("split", r6(F.col("actual_total")).alias("actual_total"),
                      r6(F.col("predicted_total")).alias("predicted_total"))


RESIDUAL_SQL = A.with_sources(f"""
SELECT observed_bin, predicted_bin, CAST(count(*) AS BIGINT) AS n_rows, round(avg(y), 6) AS observed, round(avg(mu), 6) AS predicted,
       round(avg(y - mu), 6) AS residual
FROM (SELECT y, mu,
             CASE WHEN y1 > y0 THEN least({E.GRID_BINS - 1}, CAST(floor((y - y0) / ((y1 - y0) / {E.GRID_BINS})) AS INTEGER)) ELSE 0 END AS observed_bin,
             CASE WHEN m1 > m0 THEN least({E.GRID_BINS - 1}, CAST(floor((mu - m0) / ((m1 - m0) / {E.GRID_BINS})) AS INTEGER)) ELSE 0 END AS predicted_bin
      FROM (SELECT CAST({C.TARGET} AS DOUBLE) AS y, prediction AS mu, min(CAST({C.TARGET} AS DOUBLE)) OVER () AS y0,
                   max(CAST({C.TARGET} AS DOUBLE)) OVER () AS y1, min(prediction) OVER () AS m0, max(prediction) OVER () AS m1
            FROM level_scored WHERE split = 'test'))
GROUP BY observed_bin, predicted_bin""", *C.SCORED_CTES)


@register("residual_grid", RESIDUAL_SQL)
def residual_grid(spark, sf_dir):
    test = C.level_scored(spark, sf_dir).where(F.col("split") == "test")
    out = E.residual_grid(test, C.TARGET, "prediction")
    return out.withColumns({c: r6(F.col(c)) for c in ("observed", "predicted", "residual")})


# --- calibration of several models in 100 slices (A28) ------------------------

SLICES = 100
CURVE_FEATURE = "Power"


def _sql_level_mean(level: str) -> str:
    return f"""
SELECT s.split, s.policy_key, CAST(s.{C.TARGET} AS DOUBLE) AS y,
       coalesce(m.pred, (SELECT avg(CAST({C.TARGET} AS DOUBLE)) FROM freq_split WHERE split = 'train')) AS mu
FROM freq_split s LEFT JOIN (SELECT {level} AS lvl, avg(CAST({C.TARGET} AS DOUBLE)) AS pred FROM freq_split
                             WHERE split = 'train' AND {level} IS NOT NULL GROUP BY 1) m ON s.{level} = m.lvl"""


CURVES_SQL = A.with_sources(f"""
SELECT model, split, CAST(bin AS INTEGER) AS bin, round(avg(y), 6) AS y_true_mean, round(avg(mu), 6) AS y_pred_mean,
       CAST(count(*) AS BIGINT) AS n_rows, round((bin + 0.5) / {SLICES}, 6) AS bin_center
FROM (
  SELECT *, CASE WHEN i < (n % {SLICES}) * (n // {SLICES} + 1) THEN i // (n // {SLICES} + 1)
                 ELSE (n % {SLICES}) + (i - (n % {SLICES}) * (n // {SLICES} + 1)) // greatest(n // {SLICES}, 1) END AS bin
  FROM (SELECT model, split, y, mu, row_number() OVER (PARTITION BY model, split ORDER BY mu, policy_key) - 1 AS i,
               count(*) OVER (PARTITION BY model, split) AS n
        FROM (SELECT 'mean' AS model, split, policy_key, CAST({C.TARGET} AS DOUBLE) AS y,
                     (SELECT avg(CAST({C.TARGET} AS DOUBLE)) FROM freq_split WHERE split = 'train') AS mu FROM freq_split
              UNION ALL SELECT 'type_mean', * FROM ({_sql_level_mean("Type_risk")})
              UNION ALL SELECT 'area_mean', * FROM ({_sql_level_mean("Area")})
              UNION ALL SELECT 'ridge', split, policy_key, CAST({C.TARGET} AS DOUBLE), avg_y - slope * avg_x + slope * {CURVE_FEATURE}
              FROM freq_split, (
                SELECT avg(x) AS avg_x, avg(y) AS avg_y, sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS slope
                FROM (SELECT CAST({CURVE_FEATURE} AS DOUBLE) AS x, CAST({C.TARGET} AS DOUBLE) AS y,
                             avg(CAST({CURVE_FEATURE} AS DOUBLE)) OVER () AS mx, avg(CAST({C.TARGET} AS DOUBLE)) OVER () AS my
                      FROM freq_split WHERE split = 'train')))))
GROUP BY model, split, bin""", *C.SPLIT_CTES)


@register("calibration_curves", CURVES_SQL)
def calibration_curves(spark, sf_dir):
    """Four models, both splits, 100 slices each: every cut point of the eight
    orders is found in the same passes, and no row is moved."""
    split = C.stored_split(spark, sf_dir, [C.TARGET, "Type_risk", "Area", CURVE_FEATURE])
    split = materialize(split.withColumn(CURVE_FEATURE, F.col(CURVE_FEATURE).cast("double")), "split")
    train = split.where(F.col("split") == "train")
    scored = MeanRegressor(labelCol=C.TARGET, predictionCol="mean").fit(train).transform(split)
    for level, name in (("Type_risk", "type_mean"), ("Area", "area_mean")):
        scored = MeanRegressor(labelCol=C.TARGET, groupCol=level, predictionCol=name).fit(train).transform(scored)
    ridge = RUN.pipeline_for(train, [CURVE_FEATURE], C.TARGET, "ridge", {"alpha": 1.0}, prediction="ridge").fit(train)
    scored = ridge.transform(scored).drop("features")
    out = RUN.calibration(scored, ["mean", "type_mean", "area_mean", "ridge"], "policy_key", C.TARGET, SLICES)
    return out.withColumns({c: r6(F.col(c)) for c in ("y_true_mean", "y_pred_mean", "bin_center")})


# --- the grid of a fitted model, per split (A30) ------------------------------

SCORES_SQL = A.with_sources(f"""
SELECT split, observed_bin, predicted_bin, CAST(count(*) AS BIGINT) AS n_rows, round(avg(y), 6) AS observed, round(avg(mu), 6) AS predicted,
       round(avg(y - mu), 6) AS residual
FROM (SELECT split, y, mu,
             CASE WHEN y1 > y0 THEN least({E.GRID_BINS - 1}, CAST(floor((y - y0) / ((y1 - y0) / {E.GRID_BINS})) AS INTEGER)) ELSE 0 END AS observed_bin,
             CASE WHEN m1 > m0 THEN least({E.GRID_BINS - 1}, CAST(floor((mu - m0) / ((m1 - m0) / {E.GRID_BINS})) AS INTEGER)) ELSE 0 END AS predicted_bin
      FROM (SELECT *, min(y) OVER (PARTITION BY split) AS y0, max(y) OVER (PARTITION BY split) AS y1,
                   min(mu) OVER (PARTITION BY split) AS m0, max(mu) OVER (PARTITION BY split) AS m1
            FROM (SELECT split, CAST({C.TARGET} AS DOUBLE) AS y, prediction AS mu FROM level_scored WHERE {C.LEVEL_COL} IS NOT NULL)))
GROUP BY split, observed_bin, predicted_bin""", *C.SCORED_CTES)


@register("poisson_residual_grid", SCORES_SQL)
def poisson_residual_grid(spark, sf_dir):
    """A Poisson GLM on one-hot levels predicts the levels' means; its scores are
    stored once, and the grid of each split has that split's ranges."""
    split = materialize(C.freq_split(spark, sf_dir).where(F.col(C.LEVEL_COL).isNotNull()).select("split", C.LEVEL_COL, C.TARGET), "split")
    train = split.where(F.col("split") == "train")
    staged = Pipeline(stages=[OneHotEncoder(inputCols=[C.LEVEL_COL], outputCols=["_oh"], dropLast=True),
                              VectorAssembler(inputCols=["_oh"], outputCol="features")]).fit(train)
    feats = staged.transform(train)
    glm = select_training_algorithm("poisson_regressor", {"alpha": 0.0, "max_iter": 100}).spark_estimator(feats, "features", C.TARGET)
    glm.setTol(1e-12)
    scored = glm.fit(feats).transform(staged.transform(split))
    out = E.residual_grid(scored, C.TARGET, "prediction", group_cols=["split"])
    return out.withColumns({c: r6(F.col(c)) for c in ("observed", "predicted", "residual")})
