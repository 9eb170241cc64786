"""M1–M9, G1 (FIXTURES F-9, F-10) and the penalty scalings of SURVEY §7.8."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from motorisk.models.baseline import MeanRegressor
from motorisk.models.glm import GammaRegressor, PoissonRegressor, RidgeRegressor, select_training_algorithm
from motorisk.operators import evaluation as E
from motorisk.plans import runs as RUN


def test_factory_honours_loss_and_defaults():
    plain = select_training_algorithm("gradient_boosting", {}).spark_estimator(None, "f", "y")
    assert [plain.getOrDefault(p) for p in ("loss", "growth", "maxLeaves", "minInstancesPerNode")] == ["squared", "leaf", 31, 20]
    poisson = select_training_algorithm("gradient_boosting", {"loss": "poisson", "max_leaf_nodes": 128}).spark_estimator(None, "f", "y")
    assert poisson.getOrDefault("loss") == "poisson" and poisson.getOrDefault("maxLeaves") == 128
    deep = select_training_algorithm("xgboost", {"gamma": 0.5}).spark_estimator(None, "f", "y")
    assert [deep.getOrDefault(p) for p in ("growth", "maxDepth", "regLambda", "gamma", "minChildWeight", "learningRate")] == ["depth", 6, 1.0, 0.5, 1.0, 0.3]
    with pytest.raises(ValueError):
        select_training_algorithm("gradient_boosting", {"loss": "huber"})
    with pytest.raises(TypeError):
        select_training_algorithm("ridge", {"loss": "squared_error"})


def test_factory():
    assert isinstance(select_training_algorithm("gamma_regressor", {"alpha": 10}), GammaRegressor)
    with pytest.raises(KeyError):
        select_training_algorithm("xgboooost", {})
    with pytest.raises(TypeError):
        select_training_algorithm("poisson_regressor", {"not_a_param": 1})


@pytest.fixture(scope="module")
def glm_data(spark):
    rng = np.random.default_rng(42)
    n = 400
    x = rng.normal(size=(n, 2))
    mu = np.exp(-0.5 + 0.4 * x[:, 0] - 0.3 * x[:, 1])
    y = rng.poisson(mu).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "x1 double, x2 double, y double")
    feats = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)
    return x, y, feats


def _newton_poisson(x, y, alpha, iters=50):
    n = len(y)
    X = np.column_stack([np.ones(n), x])
    w = np.zeros(X.shape[1])
    pen = np.diag([0.0] + [alpha] * x.shape[1])
    for _ in range(iters):
        mu = np.exp(X @ w)
        g = X.T @ (mu - y) / n + pen @ w
        H = X.T @ (X * mu[:, None]) / n + pen
        w -= np.linalg.solve(H, g)
    return w


@pytest.mark.parametrize("alpha", [1e-12, 0.1, 1.0])
def test_poisson_penalty_matches_objective(glm_data, alpha):
    x, y, feats = glm_data
    est = PoissonRegressor(alpha=alpha, max_iter=100, tol=1e-10).spark_estimator(feats, "features", "y")
    m = est.fit(feats)
    ref = _newton_poisson(x, y, alpha)
    assert m.intercept == pytest.approx(ref[0], abs=2e-4)
    assert np.allclose(m.coefficients.toArray(), ref[1:], atol=2e-4)


def test_ridge_penalty_matches(glm_data):
    x, y, feats = glm_data
    alpha = 5.0
    m = RidgeRegressor(alpha=alpha).spark_estimator(feats, "features", "y").fit(feats)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)


def test_gamma_saturated_is_group_mean(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(rng.gamma(2.0, 500.0 * (g + 1)))) for g in rng.integers(0, 3, 600)]
    df = spark.createDataFrame(rows, "g int, y double")
    from pyspark.ml.feature import OneHotEncoder
    oh = OneHotEncoder(inputCols=["g"], outputCols=["oh"]).fit(df)
    feats = VectorAssembler(inputCols=["oh"], outputCol="features").transform(oh.transform(df))
    m = GammaRegressor(alpha=0.0, tol=1e-12).spark_estimator(feats, "features", "y").fit(feats)
    pred = m.transform(feats).groupBy("g").agg(F.first("prediction").alias("p"), F.avg("y").alias("m")).collect()
    for r in pred:
        assert r["p"] == pytest.approx(r["m"], rel=1e-6)


def test_manifest_errors_are_not_an_empty_store(spark, tmp_path):
    from motorisk.sources.runlog import next_version
    assert next_version(spark, str(tmp_path / "none")) == 1
    bad = tmp_path / "bad" / "manifest"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        next_version(spark, str(tmp_path / "bad"))


def test_metrics_match_numpy(spark):
    y = np.array([0, 0, 1, 2, 0, 3, 1.0])
    p = np.array([0.5, 0.1, 1.2, 1.5, -0.2, 2.0, 0.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, prediction double")
    m = E.regression_metrics(df, "y").first()
    e = y - p
    assert m["mse"] == pytest.approx(np.mean(e ** 2))
    assert m["mae"] == pytest.approx(np.mean(np.abs(e)))
    assert m["medae"] == pytest.approx(np.median(np.abs(e)))
    assert m["r2"] == pytest.approx(1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))
    mask = p > 0
    yy, mu = y[mask], p[mask]
    dev = 2 * (np.where(yy == 0, 0, yy * np.log(np.where(yy == 0, 1, yy) / mu)) - yy + mu)
    assert m["poisson_deviance"] == pytest.approx(dev.mean())
    assert m["non_positive_predictions"] == 2


def test_mean_regressor_levels(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 10.0)], "g int, y double")
    m = MeanRegressor(labelCol="y", groupCol="g").fit(df)
    out = {r["g"]: r["prediction"] for r in m.transform(df.union(spark.createDataFrame([(9, 0.0)], df.schema))).collect()}
    assert out == {1: 3.0, 2: 10.0, 9: pytest.approx(16.0 / 3)}


@pytest.fixture(scope="module")
def f9(spark):
    rng = np.random.default_rng(42)
    n = 200
    years = lambda lo, hi: [f"01/01/{v}" for v in rng.integers(lo, hi + 1, n)]
    cols = {
        "policy_key": np.arange(n),
        "Year_matriculation": rng.integers(2000, 2023, n), "Type_risk": rng.integers(1, 5, n),
        "Area": rng.integers(1, 7, n), "Value_vehicle": np.round(rng.uniform(5000, 50000, n), 2),
        "Distribution_channel": rng.integers(1, 4, n), "Cylinder_capacity": rng.integers(800, 3000, n),
        "N_claims_year": rng.integers(0, 4, n), "Type_fuel": rng.choice(["Gasoline", "Diesel", "Hybrid"], n),
        "Date_birth": years(1960, 1999), "Date_driving_licence": years(1980, 2019),
        "Date_last_renewal": years(2020, 2024), "Date_start_contract": years(2015, 2022),
        "Date_next_renewal": years(2025, 2026), "Date_lapse": years(2025, 2026),
    }
    names = list(cols)
    data = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*cols.values())]
    schema = ("policy_key long, Year_matriculation long, Type_risk long, Area long, Value_vehicle double, "
              "Distribution_channel long, Cylinder_capacity long, N_claims_year long, Type_fuel string, "
              "Date_birth string, Date_driving_licence string, Date_last_renewal string, "
              "Date_start_contract string, Date_next_renewal string, Date_lapse string")
    assert len(names) == 15
    return spark.createDataFrame(data, schema)


def test_frequency_run(spark, f9, tmp_path):
    from motorisk.sources.runlog import RunLog
    cfg = {**RUN.NEW_CLIENT_CONFIG, "parameters": {"alpha": 1.0, "max_iter": 1000}}
    log = RunLog(spark, str(tmp_path / "log"))
    res = RUN.frequency_run(f9, "policy_key", cfg, log=log, store=str(tmp_path / "store"))
    keys = {(r["split"], r["name"]) for r in E.metrics_long(res.metrics, ["split"]).collect()}
    assert keys == {(s, m) for s in ("train", "test") for m in E.METRICS}
    assert set(res.plots) == {"claims_distribution", "feature_importance", "residuals", "actual_vs_predicted"}
    from motorisk.sources.runlog import load_model
    again = load_model(log.model_path(res.run_id, "poisson_model"))
    assert again.transform(f9).count() == 200
    assert res.version == 1
    logged = {r["key"] for r in log.read(res.run_id).where("kind = 'metric'").collect()}
    assert "train/mse" in logged and "test/poisson_deviance" in logged
    assert res.plots["feature_importance"].count() == 6


def test_cross_validation(f9):
    out = RUN.cross_validate(f9, ["Type_risk", "Area"], "N_claims_year", "poisson_regressor",
                             [{"alpha": 1.0}, {"alpha": 0.01}], folds=3, key="policy_key")
    rows = out.collect()
    assert len(rows) == 2 and all(r["rmse"] > 0 for r in rows)
