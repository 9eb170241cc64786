"""Positions of an order by digits: any double, grouped, with ties."""

import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorisk.operators import evaluation as E
from motorisk.operators import selection as S
from motorisk.operators.materialize import Stages
from motorisk.operators.splits import split_data

BIG = 1.7976931348623157e308
AWKWARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-310, 1.7e308, -1.7e308, BIG, -BIG,
           float("inf"), float("-inf"), 1.0, 1.0000000000000002, 0.9999999999999999, 3.0, 1e300, 4.0, 3.9999999999999996]


def bits(x):
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def images(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r.b for r in df.select("i", S.order_image(F.col("v")).alias("b")).orderBy("i").collect()]


def test_image_is_that_of_the_bits(spark):
    powers = [2.0 ** e for e in range(-1074, 1024)]
    values = AWKWARD + powers + [-p for p in powers] + [np.nextafter(p, 0) for p in powers] + [np.nextafter(p, np.inf) for p in powers]
    assert images(spark, values) == [bits(float(v)) for v in values]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=200, max_size=400))
def test_image_of_any_double(spark_session, values):
    assert images(spark_session, values) == [bits(v) for v in values]


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def at_ranks(values, p):
    """Quantile by the stated rule."""
    v = sorted(values)
    at = p * (len(v) - 1)
    low, high, share = v[int(np.floor(at))], v[int(np.ceil(at))], at - np.floor(at)
    if low == high:
        return low
    return low * (1 - share) + high * share if np.isinf(high - low) else low + (high - low) * share


@pytest.mark.parametrize("values", [
    AWKWARD, [float("inf")] * 3 + [1.0], [float("-inf"), 0.0, 1.0, float("inf")], [-BIG, BIG], [5e-324, 1e-323, -5e-324], [7.0] * 50,
    [float("nan"), 1.0, 2.0, None], [0.1 * i for i in range(1000)], [float(i % 7) for i in range(500)]])
def test_quantiles_of_awkward_values(spark, values):
    known = [v for v in values if v is not None and not np.isnan(v)]
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = S.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", probs).first()
    want = [at_ranks(known, p) for p in probs]
    assert all(a == b or np.isnan(a) and np.isnan(b) or abs(a - b) <= 1e-15 * abs(b) for a, b in zip(got, want))


def test_passes_are_bounded(spark, monkeypatch):
    """Five passes at most for a column that holds every magnitude."""
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.integers(-(1 << 62), 1 << 62, 4000).view(np.float64) if not np.isnan(x)]
    written = []
    monkeypatch.setattr(Stages, "write", lambda self, df, label="stage", f=Stages.write: written.append(label) or f(self, df, label))
    got = S.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.1, 0.5]).first()
    assert [got[0], got[1]] == [pytest.approx(at_ranks(values, p)) for p in (0.1, 0.5)]
    assert written.count("cells") + written.count("cuts") <= 6 and written.count("values") == 1


def test_stages_are_deleted(spark):
    import glob
    from motorisk.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/motorisk-work/*"
    before = set(glob.glob(folder))
    q = S.exact_quantiles(spark.range(1000).selectExpr("double(id) as v"), "v", [0.5])
    assert len(set(glob.glob(folder)) - before) == 1 and q.first()[0] == 499.5       # the one the result reads


def test_positions_of_two_columns(spark):
    rows = [(g, float(i % 3), (7919 * i) % 1000 - 500) for g in (0, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, x double, k long").repartition(7)
    stages = Stages(spark)
    got = S.select_rows(stages.write(df), ["g"], ["x", "k"], 4, lambda n, t: F.get(F.array(*map(F.lit, (0, 400, 999, 1000))), t), stages)
    for g in (0, None):
        ordered = sorted((x, k) for h, x, k in rows if h == g)
        assert {r["at"]: (r.x, r.k) for r in got.collect() if r.g == g} == {i: ordered[i] for i in (0, 400, 999)}


def scores(n, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"k": rng.permutation(n), "m": rng.choice(["a", "b"], n), "y": rng.poisson(0.4, n).astype(float), "mu": rng.gamma(2, 0.2, n).round(2)})


def test_calibration_by_cut_points(spark):
    pdf = scores(3011)
    df = spark.createDataFrame(pdf).repartition(5)
    got = E.risk_group_calibration(df, "y", "mu", "k", group_cols=["m"]).toPandas().set_index(["m", "bin"]).sort_index()
    for m, rows in pdf.sort_values(["mu", "k"]).groupby("m"):
        for i, part in enumerate(np.array_split(np.arange(len(rows)), 100)):
            r, want = got.loc[(m, i)], rows.iloc[part]
            assert r.n_rows == len(part) and np.allclose([r.y_true_mean, r.y_pred_mean, r.bin_center], [want.y.mean(), want.mu.mean(), (i + 0.5) / 100])
    assert len(got) == 200


def test_calibration_moves_no_row(spark):
    """Rows are labelled where they lie: the only exchange under the last aggregate is that of its partial sums."""
    out = E.risk_group_calibration(spark.createDataFrame(scores(500)), "y", "mu", "k", 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Sort " not in plan


@pytest.mark.parametrize("n", [0, 1, 7])
def test_calibration_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, float(i), 0.5) for i in range(n)], "k long, y double, mu double")
    got = E.risk_group_calibration(df, "y", "mu", "k", 10).collect()
    assert sorted((r.bin, r.n_rows) for r in got) == [(i, 1) for i in range(n)]


def test_grid_of_a_pipeline_per_group(spark):
    """Scores of a VectorAssembler pipeline; every group has the cells of its own range."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    pdf = scores(800).assign(x=np.arange(800.0) % 13)
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(pdf))
    scored = LinearRegression(labelCol="y", regParam=0.1).fit(df).transform(df)
    got = E.residual_grid(scored, "y", "prediction", 10, ["m"]).toPandas()
    ref = scored.select("m", "y", "prediction").toPandas()
    for m, rows in ref.groupby("m"):
        lo, hi = rows.prediction.min(), rows.prediction.max()
        bins = np.minimum(9, np.floor((rows.prediction - lo) / ((hi - lo) / 10))).astype(int)
        mine = got[got.m == m]
        assert mine.groupby("predicted_bin").n_rows.sum().to_dict() == bins.value_counts().to_dict()
        assert np.isclose((mine.residual * mine.n_rows).sum(), (rows.y - rows.prediction).sum())


def test_null_keys_are_split_too(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,), (5,)], "k long")
    for ratio, size in ((0.4, 2), (0.2, 1), (0.6, 3)):
        assert split_data(df, "k", ratio).where("split = 'test'").count() == size


def test_comparison_runs_the_dataset_once(spark):
    """The fits, the scores and the metrics read the stored columns; the dataset's own plan runs once."""
    from pyspark.sql import functions as F

    from motorisk.plans import runs as RUN
    told = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(k):
        told.add(1)
        return float(k % 3)
    df = spark.range(60).select(F.col("id").alias("k"), counted("id").alias("y"), (F.col("id") % 2).cast("double").alias("x"))
    _, metrics, _ = RUN.model_comparison(df, "k", ["x"], "y", {"baseline": ("mean", {}), "ridge": ("ridge", {"alpha": 1.0})})
    assert told.value == 60 and sum(r.n for r in metrics.collect()) == 120
