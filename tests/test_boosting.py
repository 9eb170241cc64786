"""Boosting against a plain NumPy version that grows trees one split at a time."""

import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from motorisk.models import boosting as B
from motorisk.models.boosting import BoostingRegressor
from motorisk.operators import evaluation as E
from motorisk.sources.runlog import load_model, save_model


def frame(spark, x, y):
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], f"k long, {', '.join(c + ' double' for c in cols)}, y double")
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df).repartition(4)


def data(seed, n=200, features=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, features)).astype(float)
    return x, rng.poisson(np.exp(-1 + 0.2 * x[:, 0] - 0.15 * x[:, 1] * (x[:, 2] > 5))).astype(float)


def brute(x, y, loss, rounds, rate, leaves=None, depth=None, lam=0.0, gamma=0.0, min_rows=1, min_weight=1e-3):
    """Scores and leaf counts; every split tries every threshold of every feature on the raw values."""
    eta = np.full(len(y), np.log(y.mean()) if loss == "poisson" else y.mean())
    sizes = []
    for _ in range(rounds):
        g, h = (np.exp(eta) - y, np.exp(eta)) if loss == "poisson" else (eta - y, np.ones(len(y)))
        score = lambda i: g[i].sum() ** 2 / (h[i].sum() + lam)

        def best(i, d):
            found = (0.0, None, None)
            if depth is not None and d >= depth:
                return found
            for f in range(x.shape[1]):
                for t in np.unique(x[i, f])[:-1]:
                    a, b = i[x[i, f] <= t], i[x[i, f] > t]
                    if min(len(a), len(b)) >= min_rows and min(h[a].sum(), h[b].sum()) >= min_weight:
                        gain = (score(a) + score(b) - score(i)) / 2 - gamma
                        if gain > max(found[0], 1e-12 * max(1, score(i))) + 1e-13:
                            found = (gain, a, b)
            return found
        done, open_ = [], [(np.arange(len(y)), 0, best(np.arange(len(y)), 0))]
        while open_ and (leaves is None or len(done) + len(open_) < leaves):
            k = max(range(len(open_)), key=lambda j: open_[j][2][0])
            i, d, (gain, a, b) = open_.pop(k)
            if gain <= 0:
                done.append((i, d))
                continue
            open_ += [(a, d + 1, best(a, d + 1)), (b, d + 1, best(b, d + 1))]
        ends = [i for i, _ in done] + [i for i, _, _ in open_]
        sizes.append(len(ends))
        step = np.zeros(len(y))
        for i in ends:
            step[i] = -g[i].sum() / (h[i].sum() + lam)
        eta = eta + rate * step
    return (np.exp(eta) if loss == "poisson" else eta), sizes


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("k").collect()])


@pytest.mark.parametrize("local_rows", [1 << 16, 40, 0])
def test_leaf_wise_poisson(spark, monkeypatch, local_rows):
    """The same trees whether nodes are finished in a task, measured in passes, or some of each."""
    monkeypatch.setattr(B, "LOCAL_ROWS", local_rows)
    x, y = data(1)
    df = frame(spark, x, y)
    model = BoostingRegressor(labelCol="y", loss="poisson", maxIter=3, learningRate=0.3, maxLeaves=9, minInstancesPerNode=8, checkpointEvery=2).fit(df)
    want, sizes = brute(x, y, "poisson", 3, 0.3, leaves=9, min_rows=8)
    assert np.allclose(predictions(model, df), want, rtol=1e-9)
    assert [sum(a == i for i, a in enumerate(t["left"])) for t in model.trees] == sizes and max(sizes) <= 9


@pytest.mark.parametrize("local_rows", [1 << 16, 0])
def test_penalised_depth_wise(spark, monkeypatch, local_rows):
    monkeypatch.setattr(B, "LOCAL_ROWS", local_rows)
    x, y = data(2)
    df = frame(spark, x, y)
    model = BoostingRegressor(labelCol="y", growth="depth", maxIter=3, learningRate=0.3, maxDepth=3, regLambda=1.0, gamma=0.4, minChildWeight=5.0,
                              minInstancesPerNode=1).fit(df)
    want, _ = brute(x, y, "squared", 3, 0.3, depth=3, lam=1.0, gamma=0.4, min_weight=5.0)
    assert np.allclose(predictions(model, df), want, rtol=1e-9)
    assert all(t["depth"] <= 3 for t in model.trees)


def test_missing_and_many_values(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=600), np.where(rng.random(600) < 0.3, np.nan, rng.random(600)), np.full(600, 2.0)])
    y = np.where(np.isnan(x[:, 1]), 5.0, 1.0) + x[:, 0]
    df = frame(spark, x, y)
    model = BoostingRegressor(labelCol="y", maxIter=20, learningRate=0.3, maxBins=16, minInstancesPerNode=5).fit(df)
    assert [len(e) <= 16 for e in model.edges] == [True] * 3 and model.edges[2] == []
    pred = predictions(model, df)
    assert np.mean((pred - y) ** 2) < 0.05 * y.var()
    assert model.featureImportances.toArray()[2] == 0 and model.featureImportances.toArray().sum() == pytest.approx(1)


def test_leaf_wise_is_not_above_depth_limited(spark):
    """On the claim counts of the sf0.01 tables, with the same number of leaves."""
    from motorisk.checks import common as C
    from motorisk.checks.models import RUN_FEATURES
    split = C.freq_split(spark, "/root/testdata/sf0.01").where("split = 'train'").select(*RUN_FEATURES, C.TARGET)
    df = VectorAssembler(inputCols=RUN_FEATURES, outputCol="features").transform(split)
    deviance = [E.regression_metrics(BoostingRegressor(labelCol=C.TARGET, loss="poisson", maxIter=5, **kw).fit(df).transform(df), C.TARGET).first().poisson_deviance
                for kw in (dict(growth="leaf", maxLeaves=32), dict(growth="depth", maxDepth=5))]
    assert deviance[0] <= deviance[1]


def test_saved_model_and_held_out_rows(spark, tmp_path):
    x, y = data(5, 400)
    df = frame(spark, x, y)
    est = BoostingRegressor(labelCol="y", loss="poisson", maxIter=4, maxLeaves=4, minInstancesPerNode=5, earlyStopping="on", nIterNoChange=2)
    model = Pipeline(stages=[est]).fit(df)
    save_model(model, str(tmp_path / "m"))
    again, other = load_model(str(tmp_path / "m")), Pipeline(stages=[est]).fit(df.repartition(7))
    assert np.array_equal(predictions(model, df), predictions(again, df))
    assert np.allclose(predictions(model, df), predictions(other, df), rtol=1e-9)
    with pytest.raises(Exception):
        save_model(model, str(tmp_path / "m"), overwrite=False)


def test_refusals(spark):
    df = frame(spark, np.zeros((3, 1)), np.zeros(3))
    with pytest.raises(ValueError):
        BoostingRegressor(labelCol="y", loss="poisson").fit(df)
    with pytest.raises(ValueError):
        BoostingRegressor(labelCol="y", loss="huber").fit(df)
    flat = BoostingRegressor(labelCol="y", maxIter=2).fit(df)
    assert predictions(flat, df).tolist() == [0.0] * 3
    assert flat.transform(df.withColumn("_bins", F.lit(1))).columns.count("_bins") == 1


def test_deviance_falls(spark):
    x, y = data(6)
    df = frame(spark, x, y)
    dev = [E.regression_metrics(BoostingRegressor(labelCol="y", loss="poisson", maxIter=n, learningRate=0.3, maxLeaves=6, minInstancesPerNode=5).fit(df).transform(df), "y")
           .first().poisson_deviance for n in (1, 3, 5)]
    assert dev[0] > dev[1] > dev[2]


def test_pruned_leaves_of_a_finished_subtree_stay_leaves(spark, monkeypatch):
    """A large leaf is opened while a small sibling's subtree, grown in a task, has leaves that could still be split."""
    monkeypatch.setattr(B, "LOCAL_ROWS", 100)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 8, 90), rng.integers(8, 30, 210)]).astype(float)[:, None]
    v = x[:, 0]
    y = np.where(v < 2, 1e3 * v, np.where(v < 8, 1e5 + 3e3 * v, np.where(v < 19, 1e7, 1e7 + 2e4)))
    df = frame(spark, x, y)
    model = BoostingRegressor(labelCol="y", maxIter=1, learningRate=1.0, maxLeaves=5, minInstancesPerNode=1).fit(df)
    want, sizes = brute(x, y, "squared", 1, 1.0, leaves=5)
    assert np.allclose(predictions(model, df), want, rtol=1e-9)
    assert sizes == [5] == [sum(a == i for i, a in enumerate(t["left"])) for t in model.trees]


def test_tasks_need_no_installed_package():
    """What the tasks run loads in an interpreter that cannot import the package."""
    from pyspark import cloudpickle
    sent = cloudpickle.dumps((B.grow, B.LocalMeasure, B.Node, B.Rule)).hex()
    code = f"from pyspark import cloudpickle; cloudpickle.loads(bytes.fromhex('{sent}'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), env=env).returncode == 0


def test_equal_rows_are_stored_once(spark, monkeypatch):
    """Two levels are two stored rows, whatever the number of rows; counts still decide what may be split."""
    seen = []
    kept = B.SparkMeasure.__init__
    monkeypatch.setattr(B.SparkMeasure, "__init__", lambda self, stored, groups, *a: (seen.append(groups), kept(self, stored, groups, *a))[1])
    x = (np.arange(300) % 2).astype(float)[:, None]
    y = (np.arange(300) % 5).astype(float) + 3 * x[:, 0]
    df = frame(spark, x, y)
    model = BoostingRegressor(labelCol="y", loss="poisson", maxIter=2, learningRate=0.3, maxLeaves=4, minInstancesPerNode=20).fit(df)
    want, _ = brute(x, y, "poisson", 2, 0.3, leaves=4, min_rows=20)
    assert seen == [2, 2] and np.allclose(predictions(model, df), want, rtol=1e-9)


def jobs_of(spark, run):
    """Spark jobs that ``run`` takes, and what it leaves in memory and in the checkpoint folder."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir().removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    group, files_before, held_before = f"jobs-{os.urandom(4).hex()}", files(), set(sc._jsc.getPersistentRDDs())
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group)), files() - files_before, set(sc._jsc.getPersistentRDDs()) - held_before


@pytest.mark.parametrize("kw", [dict(growth="depth", maxDepth=4, minInstancesPerNode=1), dict(loss="poisson", maxLeaves=12, minInstancesPerNode=5)])
def test_a_round_takes_a_job_and_leaves_nothing(spark, kw):
    """The trees of few rows take a job a round, besides those that write the scores; edges of many values take a few."""
    x, y = data(7, 300)
    x[:, 1] = np.random.default_rng(7).normal(size=300)
    df = frame(spark, x, y).persist()
    df.count()
    jobs, files, held = jobs_of(spark, lambda: BoostingRegressor(labelCol="y", maxIter=20, maxBins=32, **kw).fit(df))
    df.unpersist()
    assert jobs <= 20 + 20 // 5 + 20 and not files and not held


def test_leaves_that_may_be_split_are_opened_together(spark, monkeypatch):
    """Passes follow the depth of the tree, not the order in which its leaves are split."""
    monkeypatch.setattr(B, "LOCAL_ROWS", 0)
    passes, real = [], B.SparkMeasure.histograms
    monkeypatch.setattr(B.SparkMeasure, "histograms", lambda self, *a: (passes.append(1), real(self, *a))[1])
    x = np.arange(256.0)[:, None]
    y = sum((-1.0) ** (x[:, 0] // w) * w for w in (1, 2, 4, 8, 16, 32, 64, 128))            # the splits of a level gain alike, deep ones less
    model = BoostingRegressor(labelCol="y", maxIter=1, learningRate=1.0, maxLeaves=64, minInstancesPerNode=1).fit(frame(spark, x, y))
    assert sum(a == i for i, a in enumerate(model.trees[0]["left"])) == 64
    assert len(passes) <= model.trees[0]["depth"] + 2


def test_edges_are_the_values_at_even_positions(spark):
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(8)
    odd = [-np.inf, np.inf, -0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308, *[7.0] * 90]
    x = np.column_stack([np.concatenate([rng.normal(size=302) * 10.0 ** rng.integers(-9, 9, 302), odd]), rng.integers(0, 5, 400)])
    x[rng.random(400) < 0.1] = np.nan
    df = frame(spark, x, np.zeros(400))
    raw = B.blocks_of(df.select(vector_to_array("features").alias("x"), "y", F.lit(False).alias("held")))
    edges = B.bin_edges(raw, B.summary(raw, 16), 16)
    v = np.sort(x[~np.isnan(x[:, 0]), 0])
    assert edges[0] == sorted({v[(t + 1) * (len(v) - 1) // 16] for t in range(15)})
    assert edges[1] == [0.5, 1.5, 2.5, 3.5]


def test_a_tree_is_the_same_with_and_without_a_least_gain():
    """Branches that know the least gain of a split grow no less of the tree."""
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 40, (3000, 4)).astype(np.uint8)
    y = rng.poisson(np.exp(np.sin(bins[:, 0] / 5) + (bins[:, 1] > 20))).astype(float)
    sums = np.stack([y.mean() - y, np.full(3000, y.mean()), np.ones(3000)])
    tree = B.grow(B.LocalMeasure(bins, sums, 40), B.Node(0, 0.0, 0.0, 3000), B.Rule(), 20, None)
    least = min(n.gain for n in tree if n.left >= 0)
    again = B.grow(B.LocalMeasure(bins, sums, 40), B.Node(0, 0.0, 0.0, 3000), B.Rule(), 20, None, least)
    assert B.packed(tree, B.Rule()) == B.packed(again, B.Rule()) and sum(n.left >= 0 for n in tree) == 19
