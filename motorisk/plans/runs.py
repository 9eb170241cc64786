"""Training runs (G1, G2, G8) and model comparison.

A run is: split → feature stages (validated, as the reference computes them
even where the configured features are raw columns) → ``Pipeline``
(``VectorAssembler`` + estimator) fitted on train → predictions for both
splits → one grouped metrics pass for every (model, split) → plot data →
run log → optional publication of the model as a new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features.transformers import DriverFeatures, VehicleFeatures
from ..models.baseline import MeanRegressor
from ..models.glm import select_training_algorithm
from ..operators import evaluation as E
from ..operators import histograms as H
from ..operators.materialize import materialize
from ..operators.ordering import exact_quantiles
from ..operators.splits import SPLIT, TRAIN, shuffle_bucket, shuffle_key, split_data
from ..functions import bands as B
from ..sources import runlog as L

# The run configuration of the reference's new-client model.
NEW_CLIENT_CONFIG = {
    "features": ["Year_matriculation", "Type_risk", "Area", "Value_vehicle", "Distribution_channel",
                 "Cylinder_capacity"],
    "target": "N_claims_year",
    "algorithm": "poisson_regressor",
    "parameters": {"alpha": 1.0, "max_iter": 1000},
    "run_name": "run_new_client_001",
    "artifact_model_name": "poisson_model",
}
# The renewal variant differs only in its run name.
RENEWAL_CONFIG = {**NEW_CLIENT_CONFIG, "run_name": "run_renewal_001"}

# Edges of the prediction-distribution plots.
OBSERVED_EDGES = B.linspace(-1, 30, 20)
PREDICTED_EDGES = B.linspace(-1, 4, 20)


@dataclass
class RunResult:
    run_id: str
    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    plots: dict = field(default_factory=dict)
    version: int | None = None


def pipeline_for(train: DataFrame, features: Sequence[str], target: str, algorithm: str,
                 params: Mapping | None = None, prediction: str = "prediction") -> Pipeline:
    """M1 + M8: assembler and the chosen estimator, penalty scaled on train."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    builder = select_training_algorithm(algorithm, dict(params or {}))
    est = builder.spark_estimator(assembler.transform(train), "features", target, prediction)
    return Pipeline(stages=[assembler, est])


def fit_cached(pipeline: Pipeline, train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Fit with the needed columns of the training frame held in memory (and
    disk) for the iterative solver, released once the model is built."""
    train = train.select(*dict.fromkeys(columns)).persist()
    try:
        return pipeline.fit(train)
    finally:
        train.unpersist()


def featured_split(dataset: DataFrame, key: str, columns: Sequence[str], test_ratio: float, seed: int) -> DataFrame:
    """The split's ``columns`` after the feature stages of the reference (U2, U3),
    fitted on the train rows and applied to all, with the F12 guard run eagerly,
    so a non-positive vehicle value fails the run. What the stages and the run
    need of the dataset is written once, so its plan does not run per pass."""
    veh = VehicleFeatures()
    inputs, made = ([veh.getOrDefault(p) for p in ps] for ps in ((veh.fuelCol, veh.valueCol, veh.orderCol), (veh.fuelCodeCol, veh.logValueCol)))
    rows = DriverFeatures().transform(dataset).select(*dict.fromkeys([key, *[c for c in columns if c not in made], *inputs]))
    split = split_data(materialize(rows, "dataset"), key, test_ratio, True, seed)
    model = veh.fit(split.where(F.col(SPLIT) == TRAIN))
    model.validate(split)
    return model.transform(split).select(key, SPLIT, *[c for c in columns if c != key])


def coefficient_table(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Coefficient (or importance) per feature, ascending; empty
    when the model has neither."""
    spark = SparkSession.getActiveSession()
    last = model.stages[-1]
    values = None
    if hasattr(last, "coefficients"):
        values = list(last.coefficients.toArray())
    elif hasattr(last, "featureImportances"):
        imp = last.featureImportances
        values = list(imp.toArray()) if hasattr(imp, "toArray") else list(imp() if callable(imp) else imp)
    rows = [(f, float(v)) for f, v in zip(features, values)] if values is not None else []
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance")


def frequency_run(dataset: DataFrame, key: str, config: Mapping = NEW_CLIENT_CONFIG,
                  log: L.RunLog | None = None, store: str | None = None,
                  test_ratio: float = 0.2, seed: int = 42) -> RunResult:
    """G1 / G8."""
    run_id = f"{config.get('run_name', 'run')}-{uuid.uuid4().hex[:8]}"
    features, target = list(config["features"]), config["target"]
    split = featured_split(dataset, key, [*features, target], test_ratio, seed)
    train = split.where(F.col(SPLIT) == TRAIN)
    model = fit_cached(pipeline_for(train, features, target, config["algorithm"], config.get("parameters")), train,
                       [*features, target])
    # the narrow scores are the boundary behind the model: metrics and plots read them, not its plan
    scored = materialize(model.transform(split).select(key, SPLIT, F.col(target).cast("double").alias(target), "prediction"), "scores")
    metrics = E.regression_metrics(scored, target, group_cols=[SPLIT], stored=True)
    grid = E.residual_grid(scored.where(F.col(SPLIT) != TRAIN), target, "prediction", stored=True)
    plots = {
        "claims_distribution": H.histogram(scored.where(F.col(SPLIT) == TRAIN), target, 30),
        "feature_importance": coefficient_table(model, features),
        "residuals": grid.select("predicted", "residual", "n_rows"),
        "actual_vs_predicted": grid.select("observed", "predicted", "n_rows"),
    }
    if log is not None:
        log.log_parameters(run_id, {**config.get("parameters", {}), "algorithm": config["algorithm"]})
        log.log_metrics_nested(run_id, E.metrics_long(metrics, [SPLIT], prefix_col=SPLIT).drop(SPLIT))
        log.log_model(run_id, model, config.get("artifact_model_name", "model"))
        log.log_plot_data(run_id, plots)
    version = L.register_model(dataset.sparkSession, model, store, run_id)
    return RunResult(run_id, model, scored, metrics, plots, version)


SEVERITY_CONFIG = {
    "features": NEW_CLIENT_CONFIG["features"],
    "target": "Cost_claims_year",
    "parameters": {"alpha": 10.0, "max_iter": 10000},
    "run_name": "severity",
}


def severity_run(dataset: DataFrame, key: str, config: Mapping = SEVERITY_CONFIG,
                 log: L.RunLog | None = None, store: str | None = None,
                 test_ratio: float = 0.2, seed: int = 42) -> RunResult:
    """Claimants only (P8, after the split), mean baseline and
    Gamma GLM side by side, metrics of both models on both splits in one pass."""
    run_id = f"{config.get('run_name', 'run')}-{uuid.uuid4().hex[:8]}"
    features, target = list(config["features"]), config["target"]
    split = featured_split(dataset, key, [*features, target], test_ratio, seed).where(F.col(target) > 0)
    train = split.where(F.col(SPLIT) == TRAIN)
    gamma = fit_cached(pipeline_for(train, features, target, "gamma_regressor", config["parameters"],
                                    prediction="pred_gamma"), train, [*features, target])
    mean = MeanRegressor(labelCol=target, predictionCol="pred_mean").fit(train)
    scored = materialize(mean.transform(gamma.transform(split)).select(key, SPLIT, F.col(target).cast("double").alias(target), "pred_mean", "pred_gamma"), "scores")
    long = E.long_scores(scored, ["pred_mean", "pred_gamma"], [SPLIT, target])
    metrics = E.regression_metrics(long, target, group_cols=["model", SPLIT], stored=True)
    train = scored.where(F.col(SPLIT) == TRAIN)
    plots = {
        "loss_distribution": H.histogram(train, target, 40),
        "feature_importance": coefficient_table(gamma, features),
        "loss_distribution_middle95": H.histogram(_middle(train, target), target, 40),
        "residuals": E.residual_grid(scored, target, "pred_gamma", group_cols=[SPLIT], stored=True),
        "actual_vs_predicted": E.residual_grid(scored.where(F.col(SPLIT) != TRAIN), target, "pred_gamma", stored=True).select(
            "observed", "predicted", "n_rows"),
    }
    if log is not None:
        log.log_parameters(run_id, config["parameters"])
        m = E.metrics_long(metrics, ["model", SPLIT]).withColumn(
            "name", F.concat_ws("/", F.col(SPLIT), F.col("model"), F.col("name")))
        log.log_metrics_nested(run_id, m.drop("model", SPLIT))
        log.log_model(run_id, gamma, "gamma_model")
        log.log_plot_data(run_id, plots)
    version = L.register_model(dataset.sparkSession, gamma, store, run_id)
    return RunResult(run_id, gamma, scored, metrics, plots, version)


def _middle(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """Rows between the outer quantiles that leave ``share`` of them (P10)."""
    q = exact_quantiles(df, column, [(1 - share) / 2, (1 + share) / 2], ["lo", "hi"], stored=True).first()
    return df.where(F.col(column).between(q.lo, q.hi))


FREQUENCY_MODELS = {
    "baseline": ("mean", {}),
    "ridge": ("ridge", {"alpha": 1.0}),
    "poisson": ("poisson_regressor", {"alpha": 1e-12, "max_iter": 300}),
    "gbm": ("gradient_boosting", {"loss": "poisson", "max_leaf_nodes": 128}),
}


def model_comparison(dataset: DataFrame, key: str, features: Sequence[str], target: str,
                     models: Mapping[str, tuple] = FREQUENCY_MODELS, test_ratio: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every model's prediction as a column of one scored frame;
    metrics per (model, split) in one grouped pass; prediction histograms per
    (model, split) on the reference's fixed edges."""
    # every model reads the stored columns, not the dataset's plan
    split = split_data(materialize(dataset.select(*dict.fromkeys([key, *features, target])), "dataset"), key, test_ratio, True, seed)
    train = split.where(F.col(SPLIT) == TRAIN)
    scored = split
    cols = []
    for name, (algo, params) in models.items():
        out = f"pred_{name}"
        if algo == "mean":
            m = MeanRegressor(labelCol=target, predictionCol=out).fit(train)
        else:
            m = fit_cached(pipeline_for(train, features, target, algo, params, prediction=out), train, [*features, target])
        scored = m.transform(scored).drop("features")
        cols.append(out)
    # metrics and histograms read the narrow scores, not the models again
    scored = materialize(scored.select(key, SPLIT, target, *cols), "scores")
    long = E.long_scores(scored, cols, [key, SPLIT, target])
    metrics = E.regression_metrics(long, target, group_cols=["model", SPLIT], stored=True)
    observed = H.fixed_edge_histogram(scored.withColumn("model", F.lit("observed")), target,
                                      OBSERVED_EDGES, ["model", SPLIT])
    predicted = H.fixed_edge_histogram(long, "prediction", PREDICTED_EDGES, ["model", SPLIT])
    return scored, metrics, observed.unionByName(predicted)


def calibration(scored: DataFrame, models: Sequence[str], key: str, target: str, n_bins: int = 100) -> DataFrame:
    """A28 for every model (a column of ``scored``) and split; the long scores are written once."""
    long = E.long_scores(scored, models, [key, SPLIT, target])
    return E.risk_group_calibration(long, target, "prediction", key, n_bins, group_cols=["model", SPLIT])


def cross_validate(dataset: DataFrame, features: Sequence[str], target: str, algorithm: str,
                   param_grid: Sequence[Mapping], folds: int = 5, seed: int = 42,
                   metric: str = "rmse", key: str | None = None) -> DataFrame:
    """K-fold cross-validation of one algorithm over a parameter grid.

    A row's fold is a seeded hash of its ``key`` (or, without one, of its
    features and target), so it does not depend on the partition layout. Every
    fold scales the penalty on its own train part. Returns (params, mean metric)."""
    from pyspark.ml.evaluation import RegressionEvaluator

    spark = dataset.sparkSession
    columns = list(dict.fromkeys([*features, target]))
    if key is None:
        key = "_row"
        dataset = dataset.select(*columns, F.to_json(F.struct(*columns)).alias(key))
    fold = shuffle_bucket(shuffle_key(key, seed), folds)
    work = dataset.select(*columns, fold.alias("_fold")).persist()
    evaluator = RegressionEvaluator(labelCol=target, metricName=metric)
    try:
        results = []
        for params in param_grid:
            scores = []
            for i in range(folds):
                train = work.where(F.col("_fold") != i)
                model = pipeline_for(train, features, target, algorithm, params).fit(train)
                scores.append(evaluator.evaluate(model.transform(work.where(F.col("_fold") == i))))
            results.append((str(dict(params)), float(sum(scores) / folds)))
    finally:
        work.unpersist()
    return spark.createDataFrame(results, f"params string, {metric} double")
