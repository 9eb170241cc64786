"""Model evaluation as grouped aggregates.

Predictions of several models sit side by side as columns; ``long_scores``
unpivots them to (model, prediction) so that one grouped aggregate gives
the metrics of every model and split together (one shuffle, tiny groups
after the partial aggregate). The median absolute error is exact and comes
from the distributed quantile primitive, not from a per-group buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering as O
from .materialize import Stages, materialize
from .selection import select_rows

METRICS = ("mse", "rmse", "mae", "r2", "medae", "poisson_deviance")


def long_scores(df: DataFrame, pred_cols: Sequence[str], keep: Sequence[str],
                model_col: str = "model", pred: str = "prediction") -> DataFrame:
    """One row per (row, model) with the model's prediction."""
    return df.select(*keep, *pred_cols).unpivot(list(keep), list(pred_cols), model_col, pred)


def regression_metrics(df: DataFrame, label: str, pred: str = "prediction",
                       group_cols: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """M9 + P9: mse, rmse, mae, r2, medae and the mean Poisson deviance over
    rows with a positive prediction, plus the count of the other rows.

    R² = 1 − SSE / (n · var_pop(y)); a constant label gives 1 when the
    predictions are exact, else 0 (scikit-learn's convention). The scores are
    written once, unless they are ``stored`` already."""
    df = df.select(*group_cols, F.col(label).cast("double").alias(label), F.col(pred).cast("double").alias(pred))
    if not stored:
        df = materialize(df, "scores")
    y, mu = F.col(label), F.col(pred)
    e = y - mu
    unit_dev = F.when(y == 0, F.lit(0.0)).otherwise(y * F.ln(y / mu)) - y + mu
    base = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_vy"),
        F.avg(F.when(mu > 0, 2 * unit_dev)).alias("poisson_deviance"),
        F.count_if(~(mu > 0)).cast("bigint").alias("non_positive_predictions"),
    )
    med = O.exact_quantiles(df.select(*group_cols, F.abs(e).alias("_ae")), "_ae", [0.5], ["medae"],
                            group_cols=list(group_cols), stored=True)
    r2 = F.when(F.col("_vy") > 0, 1 - F.col("_sse") / (F.col("n") * F.col("_vy"))).otherwise(
        F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    out = base.join(med, list(group_cols)) if group_cols else base.withColumn("medae", med.scalar())
    return out.select(*group_cols, F.col("n").cast("bigint"), "mse", F.sqrt("mse").alias("rmse"),
                      "mae", r2.alias("r2"), "medae", "poisson_deviance", "non_positive_predictions")


def metrics_long(metrics: DataFrame, group_cols: Sequence[str] = (), names: Sequence[str] = METRICS,
                 prefix_col: str | None = None) -> DataFrame:
    """Metrics as (group..., name, value) rows; ``prefix_col`` names them
    ``prefix/name`` as the run log does."""
    long = metrics.select(*group_cols, *names).unpivot(list(group_cols), list(names), "name", "value")
    if prefix_col:
        long = long.withColumn("name", F.concat_ws("/", F.col(prefix_col), F.col("name")))
    return long


def observed_vs_predicted(df: DataFrame, feature: str, observed: str, pred: str,
                          group_cols: Sequence[str] = ()) -> DataFrame:
    """Sum of observed and predicted per feature level."""
    return df.groupBy(*group_cols, feature).agg(
        F.sum(F.col(observed).cast("double")).alias("observed"),
        F.sum(F.col(pred).cast("double")).alias("predicted"))


def portfolio_balance(df: DataFrame, observed: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Total observed against total predicted."""
    return df.groupBy(*group_cols).agg(
        F.sum(F.col(observed).cast("double")).alias("actual_total"),
        F.sum(F.col(pred).cast("double")).alias("predicted_total"))


def risk_group_calibration(df: DataFrame, observed: str, pred: str, key: str, n_bins: int = 100,
                           group_cols: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Rows in order of prediction (key, an integer, breaks ties) cut into
    ``n_bins`` even slices per group; mean observed and predicted per slice, with
    the slice centre (k + 0.5) / n_bins. A row without a prediction, or one that
    is NaN, is in no slice; a NULL key counts as the least integer.

    The first rows of slices 1, 2, ... are found as positions of the order, all
    groups and slices together, and every row is labelled where it lies by the
    number of first rows that are not behind it. No row is sorted or shuffled."""
    stages = Stages(df.sparkSession)
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col(pred).cast("double").alias("_mu"),
                     F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_key"), F.col(observed).cast("double").alias("_y"))
    rows = rows.where(F.col("_mu").isNotNull() & ~F.isnan("_mu"))
    if not stored:
        rows = stages.write(rows, "scores")
    groups = [f"_g{i}" for i in range(len(group_cols))]
    cuts = select_rows(rows, groups, ["_mu", "_key"], max(1, n_bins - 1), lambda n, t: slice_start(n, t + 1, n_bins), stages)
    # per group one array of at most n_bins - 1 cuts
    cut = F.struct(F.col("_mu").alias("mu"), F.col("_key").alias("key"))
    per_group = cuts.groupBy(*groups).agg(F.array_sort(F.collect_list(cut)).alias("_cuts"))
    if groups:
        named = per_group.select(*[F.col(c).alias(f"c{c}") for c in groups], "_cuts")
        cond = F.lit(True)
        for c in groups:
            cond = cond & F.col(c).eqNullSafe(F.col(f"c{c}"))
        labelled = rows.join(named, cond, "left")
    else:
        labelled = rows.withColumn("_cuts", per_group.select("_cuts").scalar())
    here = F.struct(F.col("_mu").alias("mu"), F.col("_key").alias("key"))
    bin_ = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<struct<mu:double,key:bigint>>")), lambda c: c <= here)).cast("int")
    out = labelled.groupBy(*groups, bin_.alias("bin")).agg(
        F.avg("_y").alias("y_true_mean"), F.avg("_mu").alias("y_pred_mean"), F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return out.select(*[F.col(a).alias(c) for a, c in zip(groups, group_cols)], "bin", "y_true_mean", "y_pred_mean", "n_rows",
                      ((F.col("bin") + 0.5) / n_bins).alias("bin_center"))


def slice_start(n: Column, i: Column, k: int) -> Column:
    """Position of the first row of slice i when n rows are cut into k even
    slices, the first n mod k of them one row longer."""
    size = F.floor(n / F.lit(k)).cast("long")
    return size * i + F.least(i.cast("long"), (n - size * F.lit(k)).cast("long"))


# Bins per axis of the actual-vs-predicted grid.
GRID_BINS = 50


def residual_grid(df: DataFrame, observed: str, pred: str, bins: int = GRID_BINS,
                  group_cols: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Actual-vs-predicted and residual plot data as 2-D binned counts per
    group: ``bins`` equal cells over the group's range of each axis, and per
    filled cell the rows, the mean observed and predicted value and the mean
    residual. Rows lacking either value (NULL or NaN) are left out.

    The scores are written once, unless they are ``stored`` already, so a model's
    plan is run once; the ranges are a row per group, joined to the scores."""
    df = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col(observed).cast("double").alias("_y"), F.col(pred).cast("double").alias("_mu"))
    groups = [f"_g{i}" for i in range(len(group_cols))] or ["_all"]
    if not group_cols:
        df = df.withColumn("_all", F.lit(0))
    if not stored:
        df = materialize(df, "scores")
    y, mu = F.col("_y"), F.col("_mu")
    df = df.where(y.isNotNull() & mu.isNotNull() & ~F.isnan(y) & ~F.isnan(mu))
    ends = df.groupBy(*[F.col(c).alias(f"r{c}") for c in groups]).agg(
        F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(mu).alias("m0"), F.max(mu).alias("m1"))
    cond = F.lit(True)
    for c in groups:
        cond = cond & F.col(c).eqNullSafe(F.col(f"r{c}"))

    def cell(v: Column, lo: str, hi: str) -> Column:
        width = (F.col(hi) - F.col(lo)) / bins
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((v - F.col(lo)) / width).cast("int"))).otherwise(F.lit(0))

    placed = df.join(ends, cond).select(*groups, "_y", "_mu", cell(y, "y0", "y1").alias("observed_bin"), cell(mu, "m0", "m1").alias("predicted_bin"))
    out = placed.groupBy(*groups, "observed_bin", "predicted_bin").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.avg(y).alias("observed"), F.avg(mu).alias("predicted"), F.avg(y - mu).alias("residual"))
    return out.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(group_cols)], "observed_bin", "predicted_bin", "n_rows",
                      "observed", "predicted", "residual")
