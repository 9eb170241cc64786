"""A18–A20 edge rules against pandas."""

import math

import pandas as pd
import pytest

from motorisk.operators import correlation as R

ROWS = [(1, 1.0, 2.0, 5.0, None), (2, 2.0, 1.0, 5.0, None), (3, 3.0, 4.0, 5.0, 1.0), (4, 4.0, 3.0, 5.0, float("nan")),
        (5, 5.0, 6.0, 5.0, None)]


@pytest.fixture
def frames(spark):
    cols = ["k", "a", "b", "c", "d"]
    df = spark.createDataFrame(ROWS, "k long, a double, b double, c double, d double")
    return df, pd.DataFrame(ROWS, columns=cols)


def _as_dict(df):
    return {(r["col_a"], r["col_b"]): r["corr"] for r in df.collect()}


def test_pearson_matches_pandas_and_edges(frames):
    df, pdf = frames
    got = _as_dict(R.pearson_matrix(df, ["a", "b", "c", "d"]))
    ref = pdf[["a", "b", "c", "d"]].corr()
    assert got[("a", "b")] == pytest.approx(ref.loc["a", "b"])
    assert got[("b", "a")] == pytest.approx(ref.loc["b", "a"])
    assert got[("a", "a")] == 1.0
    assert got[("a", "c")] is None and math.isnan(ref.loc["a", "c"])       # constant column
    assert got[("a", "d")] is None and math.isnan(ref.loc["a", "d"])       # one complete row
    assert got[("c", "c")] is None


def test_spearman_matches_pandas(frames):
    df, pdf = frames
    got = _as_dict(R.spearman_matrix(df, "k", ["a", "b", "c"]))
    ref = pdf[["a", "b", "c"]].corr(method="spearman")
    assert got[("a", "b")] == pytest.approx(ref.loc["a", "b"])
    assert got[("b", "a")] == pytest.approx(ref.loc["a", "b"])
    assert got[("a", "c")] is None


def test_feature_screen_order(frames):
    df, _ = frames
    out = R.feature_screen(df, "k", "a", ["b", "c"]).collect()
    assert [r["feature"] for r in out] == ["a", "b", "c"]
    assert out[0]["corr"] == 1.0 and out[2]["corr"] is None


def test_spearman_with_a_repeated_key(spark):
    import random
    r = random.Random(3)
    rows = [(r.randrange(4), r.random(), r.random()) for _ in range(40)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    want = pd.DataFrame(rows, columns=["k", "a", "b"])[["a", "b"]].corr("spearman").loc["a", "b"]
    assert _as_dict(R.spearman_matrix(df, "k", ["a", "b"]))[("a", "b")] == pytest.approx(want)
