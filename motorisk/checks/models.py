"""Model registrations: M2–M4 with exact SQL twins; M6, M7, M10–M12, G1,
G2, G8, S4–S6 checked by rows (their proof is in the unit tests)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from ..catalog import register
from ..models.glm import select_training_algorithm
from ..operators import evaluation as E
from ..operators.materialize import materialize
from ..plans import runs as RUN
from ..sources import runlog as L
from ..sources.files import scratch_dir
from . import common as C
from .common import r6
from .evaluation import _round_metrics, _sql_metrics
from .features import _sql_edge_dim, _sql_fixed_bins

# --- saturated GLMs: one-hot of one category predicts the level mean ----------


def _saturated(train, level: str, target: str, algorithm: str):
    enc = OneHotEncoder(inputCols=[level], outputCols=["_oh"], dropLast=True)
    asm = VectorAssembler(inputCols=["_oh"], outputCol="features")
    staged = Pipeline(stages=[enc, asm]).fit(train)
    feats = staged.transform(train).persist()
    builder = select_training_algorithm(algorithm, {"alpha": 0.0, "max_iter": 100})
    glm = builder.spark_estimator(feats, "features", target)
    glm.setTol(1e-12)
    model = glm.fit(feats)
    feats.unpersist()
    levels = train.select(level).where(F.col(level).isNotNull()).distinct()
    return model.transform(staged.transform(levels)).select(level, r6(F.col("prediction")).alias("prediction"))


POISSON_SAT_SQL = f"""
SELECT {C.LEVEL_COL}, round(avg(CAST({C.TARGET} AS DOUBLE)), 6) AS prediction
FROM freq_split WHERE split = 'train' AND {C.LEVEL_COL} IS NOT NULL GROUP BY {C.LEVEL_COL}"""


@register("poisson_saturated", C.A.with_sources(POISSON_SAT_SQL, *C.SPLIT_CTES))
def poisson_saturated(spark, sf_dir):
    train = C.freq_split(spark, sf_dir).where(F.col("split") == "train")
    return _saturated(train, C.LEVEL_COL, C.TARGET, "poisson_regressor")


GAMMA_SAT_SQL = f"""
SELECT {C.LEVEL_COL}, round(avg(Cost_claims_year), 6) AS prediction
FROM freq_split WHERE split = 'train' AND Cost_claims_year > 0 AND {C.LEVEL_COL} IS NOT NULL GROUP BY {C.LEVEL_COL}"""


# Spark's IRLS for the Gamma family settles about 5e-8 (relative) away from
# the exact level means, so both sides are given to five significant digits;
# the unit tests compare them at 1e-6.
def _digits(x):
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 4)
    return F.round(x / unit) * unit


def gamma_level_means(spark, sf_dir):
    train = C.freq_split(spark, sf_dir).where((F.col("split") == "train") & (F.col("Cost_claims_year") > 0))
    return _saturated(train, C.LEVEL_COL, "Cost_claims_year", "gamma_regressor")


GAMMA_UNIT = "pow(10.0, floor(log10(prediction)) - 4)"


@register("gamma_saturated", C.A.with_sources(
    f"SELECT {C.LEVEL_COL}, round(round(prediction / {GAMMA_UNIT}) * {GAMMA_UNIT}, 4) AS prediction FROM ({GAMMA_SAT_SQL})", *C.SPLIT_CTES))
def gamma_saturated(spark, sf_dir):
    return gamma_level_means(spark, sf_dir).withColumn("prediction", F.round(_digits(F.col("prediction")), 4))


RIDGE_FEATURE = "Power"
RIDGE_ALPHA = 1.0

RIDGE_SQL = C.A.with_sources(f"""
SELECT round(avg_y - slope * avg_x, 6) AS intercept, round(slope, 6) AS slope FROM (
  SELECT avg(x) AS avg_x, avg(y) AS avg_y,
         sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + {RIDGE_ALPHA}) AS slope
  FROM (SELECT CAST({RIDGE_FEATURE} AS DOUBLE) AS x, CAST({C.TARGET} AS DOUBLE) AS y,
               avg(CAST({RIDGE_FEATURE} AS DOUBLE)) OVER () AS mx, avg(CAST({C.TARGET} AS DOUBLE)) OVER () AS my
        FROM freq_split WHERE split = 'train'))""", *C.SPLIT_CTES)


@register("ridge_one_feature", RIDGE_SQL)
def ridge_one_feature(spark, sf_dir):
    train = C.freq_split(spark, sf_dir).where(F.col("split") == "train")
    model = RUN.pipeline_for(train, [RIDGE_FEATURE], C.TARGET, "ridge", {"alpha": RIDGE_ALPHA}).fit(train)
    lr = model.stages[-1]
    return spark.createDataFrame([(float(lr.intercept), float(lr.coefficients[0]))],
                                 "intercept double, slope double").select(
        r6(F.col("intercept")).alias("intercept"), r6(F.col("slope")).alias("slope"))


# --- boosting, GLM and comparison in closed form -------------------------------

ONE_ROUND_SQL = C.A.with_sources(f"""
SELECT x AS {C.LEVEL_COL}, round(m + 0.3 * (CASE WHEN x <= cut THEN -gl / (hl + 1) ELSE gl / (h - hl + 1) END), 6) AS prediction
FROM lv, (SELECT m, cut, gl, hl, h FROM (
  SELECT c.x AS cut, any_value(t.m) AS m, any_value(t.h) AS h, sum(l.n * t.m - l.s) AS gl, sum(l.n) AS hl
  FROM lv c, lv l, (SELECT sum(s) / sum(n) AS m, sum(n) AS h, max(x) AS top FROM lv) t
  WHERE l.x <= c.x AND c.x < t.top GROUP BY c.x)
  ORDER BY gl * gl / (hl + 1) + gl * gl / (h - hl + 1) DESC, cut LIMIT 1)""", *C.SPLIT_CTES, f"""
lv AS (SELECT {C.LEVEL_COL} AS x, CAST(count(*) AS DOUBLE) AS n, sum(CAST({C.TARGET} AS DOUBLE)) AS s
       FROM freq_split WHERE split = 'train' AND {C.LEVEL_COL} IS NOT NULL GROUP BY 1)""")


def _fitted_levels(spark, sf_dir, algorithm, params):
    """Prediction of a model on one feature, per level of it."""
    train = C.stored_split(spark, sf_dir, [C.LEVEL_COL, C.TARGET]).where((F.col("split") == "train") & F.col(C.LEVEL_COL).isNotNull()).select(C.LEVEL_COL, C.TARGET)
    model = RUN.fit_cached(RUN.pipeline_for(train, [C.LEVEL_COL], C.TARGET, algorithm, params), train, [C.LEVEL_COL, C.TARGET])
    levels = model.transform(train.select(C.LEVEL_COL).distinct()).select(C.LEVEL_COL, r6(F.col("prediction")).alias("prediction"))
    return materialize(levels, "scores")


@register("gbt_one_round", ONE_ROUND_SQL)
def gbt_one_round(spark, sf_dir):
    """M7: one tree of one split, its threshold the one of greatest penalised
    gain, its leaves shrunk by lambda."""
    return _fitted_levels(spark, sf_dir, "xgboost", {"n_estimators": 1, "max_depth": 1})


LEVEL_ROUNDS = 20


def _sql_newton(levels: str, rounds: int, key: str = "x") -> str:
    """Poisson boosting whose leaves are the levels: a Newton step of rate 0.1 per round and level."""
    return f"""
SELECT {key}, exp(eta) AS prediction FROM (
  WITH RECURSIVE step AS (
    SELECT {key}, s / n AS mean, ln(sum(s) OVER () / sum(n) OVER ()) AS eta, 0 AS round FROM ({levels})
    UNION ALL
    SELECT {key}, mean, eta + 0.1 * (mean / exp(eta) - 1), round + 1 FROM step WHERE round < {rounds})
  SELECT {key}, eta FROM step WHERE round = {rounds})"""


LEVELS_SQL = (f"SELECT {C.LEVEL_COL} AS x, CAST(count(*) AS DOUBLE) AS n, sum(CAST({C.TARGET} AS DOUBLE)) AS s FROM freq_split "
              f"WHERE split = 'train' AND {C.LEVEL_COL} IS NOT NULL GROUP BY 1")


@register("poisson_gbm_levels", C.A.with_sources(
    f"SELECT x AS {C.LEVEL_COL}, round(prediction, 6) AS prediction FROM ({_sql_newton(LEVELS_SQL, LEVEL_ROUNDS)})", *C.SPLIT_CTES))
def poisson_gbm_levels(spark, sf_dir):
    """M6: with a leaf for every level, each round is a Newton step per level."""
    return _fitted_levels(spark, sf_dir, "gradient_boosting", {"loss": "poisson", "max_leaf_nodes": 128, "max_iter": LEVEL_ROUNDS})


# A yes/no feature: the Poisson GLM and the boosted trees then predict per level, in closed form.
FLAG = "second_driver_flag"
FLAG_CTE = f"""
flagged AS (SELECT split, CAST({C.TARGET} AS DOUBLE) AS y, CAST(coalesce(Second_driver >= 1, false) AS INTEGER) AS x FROM freq_split)"""
FLAG_LEVELS = "SELECT x, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM flagged WHERE split = 'train' GROUP BY x"
FLAG_SCORES = f"""
SELECT model, split, y, mu FROM (
  SELECT 'pred_baseline' AS model, split, y, (SELECT avg(y) FROM flagged WHERE split = 'train') AS mu FROM flagged
  UNION ALL SELECT 'pred_ridge', split, y, avg_y - slope * avg_x + slope * x FROM flagged, (
    SELECT avg_x, avg_y, sxy / (sxx + 1.0) AS slope FROM (
      SELECT avg(x) AS avg_x, avg(y) AS avg_y, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM flagged WHERE split = 'train'))
  UNION ALL SELECT 'pred_poisson', f.split, f.y, l.s / l.n FROM flagged f JOIN ({FLAG_LEVELS}) l ON f.x = l.x
  UNION ALL SELECT 'pred_gbm', f.split, f.y, b.prediction FROM flagged f JOIN ({_sql_newton(FLAG_LEVELS, 100)}) b ON f.x = b.x)"""


def flag_dataset(spark, sf_dir):
    return C.freq_dataset(spark, sf_dir).select("policy_key", C.TARGET, F.coalesce((F.col("Second_driver") >= 1).cast("int"), F.lit(0)).alias(FLAG))


@register("model_comparison_flag", C.A.with_sources(
    f"SELECT model, split, {_sql_metrics('y', 'mu')} FROM ({FLAG_SCORES}) GROUP BY model, split", *C.SPLIT_CTES, FLAG_CTE))
def model_comparison_flag(spark, sf_dir):
    """The four models of the comparison on one yes/no feature."""
    _, metrics, _ = RUN.model_comparison(flag_dataset(spark, sf_dir), "policy_key", [FLAG], C.TARGET)
    return _round_metrics(metrics, ["model", "split"])


def _sql_flag_histograms() -> str:
    parts = [("SELECT 'observed' AS model, split, y AS v FROM flagged", RUN.OBSERVED_EDGES),
             (f"SELECT model, split, mu AS v FROM ({FLAG_SCORES})", RUN.PREDICTED_EDGES)]
    body = "\nUNION ALL\n".join(f"""
SELECT g.model, g.split, CAST(d.bin AS INTEGER) AS bin, round(d.lo, 6) AS lo, round(d.hi, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM {_sql_edge_dim(edges)} CROSS JOIN (SELECT DISTINCT model, split FROM ({src})) g
LEFT JOIN (SELECT model, split, bin, count(*) AS n FROM (SELECT model, split, {_sql_fixed_bins('v', edges)} AS bin FROM ({src}))
           WHERE bin IS NOT NULL GROUP BY ALL) c ON d.bin = c.bin AND g.model = c.model AND g.split = c.split""" for src, edges in parts)
    return C.A.with_sources(body, *C.SPLIT_CTES, FLAG_CTE)


@register("prediction_histograms_flag", _sql_flag_histograms())
def prediction_histograms_flag(spark, sf_dir):
    """Observed and predicted distributions of the same four models."""
    _, _, hist = RUN.model_comparison(flag_dataset(spark, sf_dir), "policy_key", [FLAG], C.TARGET)
    return hist


@register("coefficients_flag", C.A.with_sources(
    f"SELECT '{FLAG}' AS feature, round(ln(max(s / n) FILTER (WHERE x = 1) / max(s / n) FILTER (WHERE x = 0)), 5) AS importance FROM ({FLAG_LEVELS})",
    *C.SPLIT_CTES, FLAG_CTE))
def coefficients_flag(spark, sf_dir):
    """The log of the ratio of the two levels' means."""
    train = C.split_data(flag_dataset(spark, sf_dir), "policy_key", C.TEST_RATIO, True, C.SEED).where(F.col("split") == "train")
    model = RUN.pipeline_for(train, [FLAG], C.TARGET, "poisson_regressor", {"alpha": 0.0, "max_iter": 300, "tol": 1e-10}).fit(train)
    return RUN.coefficient_table(model, [FLAG]).withColumn("importance", F.round("importance", 5))


FOLDS = 5
CV_GRID = ({"alpha": 1.0}, {"alpha": 1000.0})

CV_SQL = C.A.with_sources(f"""
SELECT params, round(avg(rmse), 6) AS rmse FROM (
  SELECT a.params, f.fold, sqrt(avg(pow(f.y - (m.avg_y + m.sxy / (m.sxx + a.alpha) * (f.x - m.avg_x)), 2))) AS rmse
  FROM folded f
  JOIN (SELECT k.fold, avg(x) AS avg_x, avg(y) AS avg_y, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
        FROM folded t JOIN (SELECT DISTINCT fold FROM folded) k ON t.fold <> k.fold GROUP BY k.fold) m ON f.fold = m.fold
  CROSS JOIN (VALUES {", ".join(f"({C.sql_quote(str(p))}, CAST({p['alpha']} AS DOUBLE))" for p in CV_GRID)}) a(params, alpha)
  GROUP BY a.params, f.fold)
GROUP BY params""", C.FREQ_DS_CTE, f"""
folded AS (SELECT CAST({C.TARGET} AS DOUBLE) AS y, CAST(coalesce(Second_driver >= 1, false) AS DOUBLE) AS x,
                  CAST(floor(CAST('0x' || substr(md5(CAST(policy_key AS VARCHAR) || '{C.SEED}'), 1, 8) AS BIGINT) * {FOLDS} / 4294967296.0) AS INTEGER) AS fold
           FROM freq_ds)""")


@register("cross_validation_flag", CV_SQL)
def cross_validation_flag(spark, sf_dir):
    """A grid of ridge penalties on one yes/no feature, five folds."""
    out = RUN.cross_validate(flag_dataset(spark, sf_dir), [FLAG], C.TARGET, "ridge", CV_GRID, FOLDS, C.SEED, key="policy_key")
    return out.select("params", r6(F.col("rmse")).alias("rmse"))


# --- rows-only: boosted models, runs, comparison, coefficients, versions ------

RUN_FEATURES = RUN.NEW_CLIENT_CONFIG["features"]


def _split_metrics(spark, sf_dir, algorithm, params):
    split = C.stored_split(spark, sf_dir, [*RUN_FEATURES, C.TARGET])
    train = split.where(F.col("split") == "train")
    model = RUN.fit_cached(RUN.pipeline_for(train, RUN_FEATURES, C.TARGET, algorithm, params), train, [*RUN_FEATURES, C.TARGET])
    scored = model.transform(split)
    return E.regression_metrics(scored, C.TARGET, group_cols=["split"])


@register("poisson_gbm")
def poisson_gbm(spark, sf_dir):
    return _split_metrics(spark, sf_dir, *RUN.FREQUENCY_MODELS["gbm"])


@register("gbt_squared")
def gbt_squared(spark, sf_dir):
    return _split_metrics(spark, sf_dir, "xgboost", {})


@register("frequency_run")
def frequency_run(spark, sf_dir):
    """G1 with both configurations (G8): metrics rows per run and split."""
    pol = C.A.policies(spark, sf_dir)
    log = L.RunLog(spark, scratch_dir(spark, "runlog"))
    out = None
    for cfg in (RUN.NEW_CLIENT_CONFIG, RUN.RENEWAL_CONFIG):
        res = RUN.frequency_run(pol, "policy_key", cfg, log=log)
        m = E.metrics_long(res.metrics, ["split"]).withColumn("run_name", F.lit(cfg["run_name"]))
        out = m if out is None else out.unionByName(m)
    return out


@register("severity_run")
def severity_run(spark, sf_dir):
    res = RUN.severity_run(C.A.policies(spark, sf_dir), "policy_key",
                           log=L.RunLog(spark, scratch_dir(spark, "runlog")))
    return res.metrics


@register("model_comparison")
def model_comparison(spark, sf_dir):
    _, metrics, _ = RUN.model_comparison(C.freq_dataset(spark, sf_dir), "policy_key", RUN_FEATURES, C.TARGET)
    return metrics


@register("prediction_histograms")
def prediction_histograms(spark, sf_dir):
    _, _, hist = RUN.model_comparison(C.freq_dataset(spark, sf_dir), "policy_key", RUN_FEATURES, C.TARGET)
    return hist


@register("coefficients")
def coefficients(spark, sf_dir):
    split = C.freq_split(spark, sf_dir)
    train = split.where(F.col("split") == "train")
    model = RUN.pipeline_for(train, RUN_FEATURES, C.TARGET, "poisson_regressor",
                             RUN.NEW_CLIENT_CONFIG["parameters"]).fit(train)
    return RUN.coefficient_table(model, RUN_FEATURES)


@register("model_versions", "SELECT * FROM (VALUES (1), (2)) AS t(version)")
def model_versions(spark, sf_dir):
    """S5 + S6: the frequency model published twice gets versions 1 and 2."""
    store = scratch_dir(spark, "models")
    pol = C.A.policies(spark, sf_dir)
    for _ in range(2):
        RUN.frequency_run(pol, "policy_key", RUN.NEW_CLIENT_CONFIG, store=store)
    return L.model_versions(spark, store).select("version")     # the paths carry random folder names
