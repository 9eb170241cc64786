"""Regression estimators of the reference, as ``pyspark.ml`` estimators (M1–M4, M7).

Penalty scaling (SURVEY §7.8): the reference minimises the mean
half-deviance plus alpha/2·‖w‖² with an unpenalised intercept. Spark's IRLS
normalises the penalty by the sum of the working weights, which for the
Poisson family with log link equals the sum of mu, i.e. the sum of y at the
optimum; hence ``regParam = alpha / mean(y)``. The Gamma family with log
link has unit weights, hence ``regParam = alpha``. Ridge is fitted by
``LinearRegression`` on the unstandardised features; Spark divides the
penalty by the label's population deviation, hence
``regParam = alpha / n · stddev_pop(y)``.

The statistics these scalings need (mean, count, deviation of the label) are
one aggregate over the training frame.
"""

from __future__ import annotations

import inspect

from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostingRegressor


def _label_stats(df: DataFrame, label: str):
    y = F.col(label).cast("double")
    return df.agg(F.avg(y).alias("m"), F.count(y).alias("n"), F.stddev_pop(y).alias("s")).first()


class PenalisedGLM:
    """Builder that defers the penalty scaling to the training frame."""

    family = "poisson"

    def __init__(self, alpha: float = 1.0, max_iter: int = 100, tol: float = 1e-4, fit_intercept: bool = True):
        self.alpha, self.max_iter, self.tol, self.fit_intercept = alpha, max_iter, tol, fit_intercept

    def reg_param(self, df: DataFrame, label: str) -> float:
        raise NotImplementedError

    def spark_estimator(self, df: DataFrame, features: str, label: str, prediction: str = "prediction"):
        return GeneralizedLinearRegression(
            family=self.family, link="log", featuresCol=features, labelCol=label,
            predictionCol=prediction, regParam=self.reg_param(df, label), maxIter=self.max_iter,
            tol=self.tol, fitIntercept=self.fit_intercept)


class PoissonRegressor(PenalisedGLM):
    """M2: Poisson GLM with log link."""

    family = "poisson"

    def reg_param(self, df, label):
        if not self.fit_intercept and self.alpha:
            # the weights only sum to the labels' sum when the intercept is free
            raise ValueError("a penalised Poisson fit needs its intercept")
        m = _label_stats(df, label)["m"]
        return float(self.alpha) / float(m) if m else float(self.alpha)


class GammaRegressor(PenalisedGLM):
    """M3: Gamma GLM with log link (Spark's default link for Gamma is inverse)."""

    family = "gamma"

    def reg_param(self, df, label):
        return float(self.alpha)


class RidgeRegressor:
    """M4: linear model with an L2 penalty, unstandardised."""

    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True):
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def spark_estimator(self, df, features, label, prediction="prediction"):
        st = _label_stats(df, label)
        reg = float(self.alpha) / float(st["n"]) * float(st["s"] or 0.0)
        return LinearRegression(featuresCol=features, labelCol=label, predictionCol=prediction,
                                regParam=reg, elasticNetParam=0.0, standardization=False,
                                solver="normal", fitIntercept=self.fit_intercept)


class SquaredBoosting:
    """M7: boosted trees on squared loss with penalised leaves, grown by depth
    (defaults of the reference's library: 100 rounds, depth 6, rate 0.3, lambda 1,
    no minimum gain, child weight 1)."""

    def __init__(self, n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.3, reg_lambda: float = 1.0,
                 gamma: float = 0.0, min_child_weight: float = 1.0, max_bins: int = 256, checkpoint_every: int = 5):
        self.kw = dict(maxIter=n_estimators, maxDepth=max_depth, learningRate=learning_rate, regLambda=reg_lambda, gamma=gamma,
                       minChildWeight=min_child_weight, maxBins=max_bins, checkpointEvery=checkpoint_every)

    def spark_estimator(self, df, features, label, prediction="prediction"):
        return BoostingRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, loss="squared", growth="depth",
                                 minInstancesPerNode=1, **self.kw)


class HistogramBoosting:
    """M6: histogram-style gradient boosting, leaf of greatest gain first (defaults
    of the reference's library: squared error, 31 leaves). ``loss`` is
    ``squared_error`` or ``poisson``."""

    LOSSES = {"squared_error": "squared", "poisson": "poisson"}

    def __init__(self, loss: str = "squared_error", max_iter: int = 100, learning_rate: float = 0.1, max_leaf_nodes: int = 31,
                 max_depth: int | None = None, min_samples_leaf: int = 20, l2_regularization: float = 0.0, max_bins: int = 255,
                 early_stopping: bool = False, checkpoint_every: int = 5):
        if loss not in self.LOSSES:
            raise ValueError(f"loss is one of {tuple(self.LOSSES)}")
        self.kw = dict(loss=self.LOSSES[loss], maxIter=max_iter, learningRate=learning_rate, maxLeaves=max_leaf_nodes, maxDepth=max_depth or 0,
                       minInstancesPerNode=min_samples_leaf, regLambda=l2_regularization, maxBins=max_bins,
                       earlyStopping="on" if early_stopping else "off", checkpointEvery=checkpoint_every)

    def spark_estimator(self, df, features, label, prediction="prediction"):
        return BoostingRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, growth="leaf", **self.kw)


# Algorithm names accepted by the factory.
ALGORITHMS = {
    "xgboost": SquaredBoosting,
    "poisson_regressor": PoissonRegressor,
    "gamma_regressor": GammaRegressor,
    "gradient_boosting": HistogramBoosting,
    "ridge": RidgeRegressor,
}

def select_training_algorithm(name: str, params: dict | None = None):
    """M1: builder by name, with its own defaults. Unknown name -> KeyError;
    unknown parameter -> TypeError when the builder is made. ``solver`` is
    accepted and ignored (Spark owns the solver)."""
    cls = ALGORITHMS[name]
    params = dict(params or {})
    params.pop("solver", None)
    accepted = set(inspect.signature(cls.__init__).parameters) - {"self"}
    unknown = set(params) - accepted
    if unknown:
        raise TypeError(f"{cls.__name__} got unexpected keyword argument(s) {sorted(unknown)}")
    return cls(**params)
