"""Serving and I/O registrations: G7, T1, S1, S4, S5, S8."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from ..catalog import register
from ..features.transformers import CarAge
from ..functions import dates as D
from ..models.baseline import MeanRegressor
from ..models.glm import PoissonRegressor
from ..operators import evaluation as E
from ..sources import runlog as L
from ..sources.files import load_delimited, scratch_dir
from ..streaming.scoring import QUOTE_SCHEMA, score_quotes, start_scoring_stream
from . import common as C
from .common import r6

AS_OF_YEAR = 2018
REJECT_EVERY = 50
QUOTE_FIELDS = [f.name for f in QUOTE_SCHEMA.fields]


def _with_car_age(df):
    return df.withColumn("Car_age_years", D.abs_int_difference("Year_matriculation", AS_OF_YEAR).cast("int"))


def quotes(spark, sf_dir):
    """One quote per policy as a JSON envelope; in every 50th quote the risk
    type is text that is not a number, so the request must be rejected."""
    pol = _with_car_age(C.A.policies(spark, sf_dir))
    bad = F.col("policy_key") % REJECT_EVERY == 0
    fields = [F.when(bad, F.concat(F.lit("type-"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
              .alias(c) if c == "Type_risk" else F.col(c) for c in QUOTE_FIELDS]
    valid = F.to_json(F.struct(*QUOTE_FIELDS))
    body = F.when(bad, F.to_json(F.struct(*fields))).otherwise(valid)
    return pol.select(F.col("policy_key").alias("quote_id"), body.alias("body"))


def scoring_model(spark, sf_dir):
    """Feature stages and Poisson GLM fitted on the training split, saved
    and loaded back. The GLM is saturated in the risk type, so its predictions
    are the level means of the SQL twin."""
    columns = ["Year_matriculation", *[f for f in QUOTE_FIELDS if f != "Car_age_years"], C.TARGET]
    train = C.stored_split(spark, sf_dir, columns).where(F.col("split") == "train").select(*columns)
    features = Pipeline(stages=[
        CarAge(asOfYear=AS_OF_YEAR),
        OneHotEncoder(inputCols=[C.LEVEL_COL], outputCols=["_level"], dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["_level"], outputCol="features"),
    ]).fit(train)
    ready = features.transform(train).select("features", C.TARGET).persist()       # the solver reads it once per step
    glm = PoissonRegressor(alpha=0.0, max_iter=100, tol=1e-12).spark_estimator(ready, "features", C.TARGET)
    pipe = PipelineModel([*features.stages, glm.fit(ready)])
    ready.unpersist()
    path = scratch_dir(spark, "quote-model")
    L.save_model(pipe, path)
    return L.load_model(path)


SCORE_SQL = C.A.with_sources(f"""
SELECT policy_key AS quote_id,
       CASE WHEN policy_key % {REJECT_EVERY} = 0 THEN 'rejected' ELSE 'scored' END AS status,
       CASE WHEN policy_key % {REJECT_EVERY} = 0 THEN NULL ELSE round(prediction, 6) END AS prediction
FROM level_scored""", *C.SCORED_CTES)


@register("score_quotes", SCORE_SQL)
def score_quotes_batch(spark, sf_dir):
    out = score_quotes(scoring_model(spark, sf_dir), quotes(spark, sf_dir))
    return out.withColumn("prediction", r6(F.col("prediction")))


@register("score_quotes_stream", SCORE_SQL)
def score_quotes_stream(spark, sf_dir):
    """The same quotes as JSON files, each delivered twice, scored by a stream (availableNow)."""
    src = scratch_dir(spark, "quotes-in")
    for _ in range(2):
        quotes(spark, sf_dir).write.mode("append").json(src)
    sink, ckpt = scratch_dir(spark, "quotes-out"), scratch_dir(spark, "quotes-ckpt")
    q = start_scoring_stream(spark, scoring_model(spark, sf_dir), src, sink, ckpt)
    q.awaitTermination()                            # ends with the input; a failure is raised here
    return spark.read.parquet(sink).withColumn("prediction", r6(F.col("prediction")))


# Spark's IRLS settles up to 2e-7 away from the exact level means here, so both sides are given to four digits.
VERSIONS_SQL = C.A.with_sources(f"""
SELECT 1 AS version, {C.LEVEL_COL}, round(avg(CAST({C.TARGET} AS DOUBLE)), 4) AS prediction
FROM freq_split WHERE split = 'train' AND {C.LEVEL_COL} IS NOT NULL GROUP BY {C.LEVEL_COL}
UNION ALL
SELECT 2, {C.LEVEL_COL}, round(avg(CAST({C.TARGET} AS DOUBLE)), 4) FROM freq_split WHERE {C.LEVEL_COL} IS NOT NULL GROUP BY {C.LEVEL_COL}""", *C.SPLIT_CTES)


@register("published_models", VERSIONS_SQL)
def published_models(spark, sf_dir):
    """S5 + S6: a GLM fitted on the training rows and one fitted on all rows are
    published in turn; every version is loaded from the store and predicts the levels."""
    store = scratch_dir(spark, "store")
    split = C.stored_split(spark, sf_dir, [C.LEVEL_COL, C.TARGET]).where(F.col(C.LEVEL_COL).isNotNull()).select("split", C.LEVEL_COL, C.TARGET)
    for rows in (split.where(F.col("split") == "train"), split):
        staged = Pipeline(stages=[OneHotEncoder(inputCols=[C.LEVEL_COL], outputCols=["_level"], dropLast=True),
                                  VectorAssembler(inputCols=["_level"], outputCol="features")]).fit(rows)
        ready = staged.transform(rows).select("features", C.TARGET).persist()       # the solver reads it once per step
        glm = PoissonRegressor(alpha=0.0, max_iter=100, tol=1e-12).spark_estimator(ready, "features", C.TARGET)
        L.register_model(spark, PipelineModel([*staged.stages, glm.fit(ready)]), store, "levels")
        ready.unpersist()
    levels, out = split.select(C.LEVEL_COL).distinct(), None
    for r in sorted(L.model_versions(spark, store).collect(), key=lambda r: r.version):
        told = L.load_model(r.path).transform(levels).select(F.lit(r.version).alias("version"), C.LEVEL_COL, F.round("prediction", 4).alias("prediction"))
        out = told if out is None else out.unionByName(told)
    return out


# --- run log (S4) ------------------------------------------------------------

RUN_PARAMS = {"algorithm": "mean", "target": C.TARGET}
LOG_METRICS = ("mse", "rmse", "mae", "r2", "medae", "poisson_deviance")


def _run_log_sql() -> str:
    from .evaluation import _sql_metrics
    m = f"""m AS (
  SELECT split, {_sql_metrics('y', 'mu')} FROM (
    SELECT split, CAST({C.TARGET} AS DOUBLE) AS y,
           (SELECT avg(CAST({C.TARGET} AS DOUBLE)) FROM freq_split WHERE split = 'train') AS mu
    FROM freq_split) GROUP BY split)"""
    parts = [f"SELECT 'param' AS kind, '{k}' AS key, CAST(NULL AS DOUBLE) AS value, '{v}' AS text"
             for k, v in RUN_PARAMS.items()]
    parts += [f"SELECT 'metric', split || '/{n}', {n}, CAST(NULL AS VARCHAR) FROM m" for n in LOG_METRICS]
    return C.A.with_sources("\nUNION ALL\n".join(parts), *C.SPLIT_CTES, m)


@register("run_log", _run_log_sql())
def run_log(spark, sf_dir):
    split = C.freq_split(spark, sf_dir)
    model = MeanRegressor(labelCol=C.TARGET).fit(split.where(F.col("split") == "train"))
    metrics = E.regression_metrics(model.transform(split), C.TARGET, group_cols=["split"])
    log = L.RunLog(spark, scratch_dir(spark, "runlog"))
    log.log_parameters("run-1", RUN_PARAMS)
    log.log_metrics_nested("run-1", E.metrics_long(metrics, ["split"], LOG_METRICS, prefix_col="split").drop("split"))
    return log.read("run-1").select("kind", "key", r6(F.col("value")).alias("value"), "text")


# --- delimited round trip (S1) -----------------------------------------------

@register("csv_round_trip", C.A.with_sources("SELECT * FROM policies"))
def csv_round_trip(spark, sf_dir):
    """Policies written as ';' text with NA for missing, read back by the
    NA-aware reader with the fixed schema."""
    pol = C.A.policies(spark, sf_dir)
    path = scratch_dir(spark, "policies-csv")
    pol.write.option("header", True).option("sep", ";").option("nullValue", "NA").csv(path)
    return load_delimited(spark, path, pol.schema)
