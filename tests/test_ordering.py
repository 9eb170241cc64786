"""Distributed order primitives against single-machine results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motorisk.operators import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 5000
    v = rng.integers(0, 40, n)
    x = np.where(np.arange(n) % 9 == 0, np.nan, rng.normal(size=n))
    g = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"k": np.arange(n), "v": v, "x": x, "g": g})
    df = spark.createDataFrame([(int(a), int(b), None if np.isnan(c) else float(c), int(d))
                                for a, b, c, d in pdf.itertuples(index=False)], "k long, v int, x double, g int")
    return df, pdf


def test_row_index_equals_row_number(data):
    df, _ = data
    ri = O.row_index(df, ["v", "k"], "ri", partitions=5)
    ref = df.select("k", (F.row_number().over(Window.orderBy("v", "k")) - 1).alias("rn"))
    assert ri.join(ref, "k").where("ri != rn").count() == 0


def test_grouped_row_index(data):
    df, _ = data
    ri = O.row_index(df, ["x", "k"], "ri", group_cols=["g"], partitions=4)
    ref = df.select("k", (F.row_number().over(Window.partitionBy("g").orderBy("x", "k")) - 1).alias("rn"))
    assert ri.join(ref, "k").where("ri != rn").count() == 0


def test_average_rank(data):
    df, pdf = data
    got = O.average_rank(df, "v", "r").select("k", "r").toPandas().set_index("k").sort_index()
    assert np.allclose(got["r"].values, pdf["v"].rank().values)


def test_exact_quantiles(data):
    df, pdf = data
    q = O.exact_quantiles(df, "x", [0.0, 0.025, 0.5, 0.975, 1.0]).first()
    ref = np.percentile(pdf["x"].dropna(), [0, 2.5, 50, 97.5, 100])
    assert np.allclose(list(q), ref)


def test_grouped_quantiles(data):
    df, pdf = data
    got = {r["g"]: r["m"] for r in O.exact_quantiles(df, "x", [0.5], ["m"], group_cols=["g"]).collect()}
    for g, m in got.items():
        assert m == pytest.approx(np.median(pdf[pdf.g == g]["x"].dropna()))


@pytest.mark.parametrize("n,k", [(103, 10), (100, 10), (7, 10)])
def test_even_slices(spark, n, k):
    df = spark.range(n).withColumn("s", O.even_slice("id", F.lit(n), k))
    got = [r["s"] for r in df.orderBy("id").collect()]
    ref = np.concatenate([np.full(len(a), i) for i, a in enumerate(np.array_split(np.arange(n), k))])
    assert got == list(ref)


def test_hot_value_and_hot_group(spark):
    """One value holds a third of all rows, inside one group that holds most
    rows: ranks and quantiles stay exact, and the distinct-value frame the
    shuffle carries has one row for it."""
    rng = np.random.default_rng(11)
    n = 6000
    v = np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(size=n).round(3))
    g = np.where(np.arange(n) % 10 < 8, 0, 1)
    pdf = pd.DataFrame({"k": np.arange(n), "v": v, "g": g})
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in pdf.itertuples(index=False)],
                               "k long, v double, g int")
    pos = O.value_positions(df, "v", ["g"])
    assert pos.where("v = 7.0").count() == 2          # one row per group for the hot value
    got = O.average_rank(df, "v", "r", ["g"]).select("k", "r").toPandas().set_index("k").sort_index()
    ref = pdf.groupby("g")["v"].rank()
    assert np.allclose(got["r"].values, ref.values)
    q = {r["g"]: (r["a"], r["b"]) for r in O.exact_quantiles(df, "v", [0.3, 0.9], ["a", "b"], ["g"]).collect()}
    for grp, (a, b) in q.items():
        ref_q = np.percentile(pdf[pdf.g == grp]["v"], [30, 90])
        assert (a, b) == pytest.approx(tuple(ref_q))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "k long, v double")
    idx, n = O.row_index_and_count(empty, ["v", "k"], "i")
    assert n == 0 and idx.count() == 0
    q = O.exact_quantiles(empty, "v", [0.5], ["m"]).collect()
    assert len(q) == 1 and q[0]["m"] is None

    few = spark.createDataFrame([(i, float(i % 3)) for i in range(5)], "k long, v double")
    idx = O.row_index(few, ["v", "k"], "i", partitions=50)        # more partitions than rows
    assert sorted(r["i"] for r in idx.collect()) == list(range(5))
    one = spark.createDataFrame([(1, 2.5)], "k long, v double")
    assert O.exact_quantiles(one, "v", [0.0, 0.5, 1.0], ["a", "b", "c"]).first() == (2.5, 2.5, 2.5)
    nulls = spark.createDataFrame([(1, None), (2, None)], "k long, v double")
    assert O.average_rank(nulls, "v", "r").where("r IS NOT NULL").count() == 0
    const = spark.createDataFrame([(i, 1.0) for i in range(4)], "k long, v double")
    assert {r["r"] for r in O.average_rank(const, "v", "r").collect()} == {2.5}
