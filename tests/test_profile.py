"""Profile: duplicates by fingerprints, the report's passes, ranks by look-up."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorisk.operators import correlation as R
from motorisk.operators import moments as M
from motorisk.operators import profile as P
from motorisk.operators.materialize import Stages
from motorisk.plans.premium import premium_dataset
from motorisk.sources import adapter as A

from conftest import SF_SMALL


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


def test_duplicates(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, "a", 0.0), (None, "a", 1.0), (None, "a", 1.0), (1, None, 1.0), (None, "1", 1.0), (2, "b", float("nan")), (2, "b", float("nan"))]
    df = spark.createDataFrame(rows, "x int, y string, z double").repartition(4)
    assert P.duplicate_count(df).first()[0] == 4
    assert P.duplicate_count(df.distinct()).first()[0] == 0
    assert P.duplicate_count(df.limit(0)).first()[0] == 0


def test_duplicates_among_equal_fingerprints(spark, monkeypatch):
    """Unequal rows that share a fingerprint are told apart."""
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(i % 6, "v") for i in range(8)], "x int, y string")
    assert P.duplicate_count(df).first()[0] == 2


def test_rows_seen_once_are_not_shuffled(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as a", "cast(id as string) as b")
    assert P.duplicate_count(df).first()[0] == 0
    both = df.unionByName(df.where("id < 3"))
    assert P.duplicate_count(both).first()[0] == 3


def test_report_reads_the_frame_once(spark, monkeypatch):
    """The premium frame is run for one write; all sections read stored tables."""
    prem = premium_dataset(A.policies(spark, SF_SMALL))
    written = []
    from motorisk.operators.materialize import Stages
    monkeypatch.setattr(Stages, "write", lambda self, df, label="stage", f=Stages.write: written.append((label, df)) or f(self, df, label))
    out = P.profile_report(prem, "policy_key")
    scans = lambda df: sum(t in df._jdf.queryExecution().optimizedPlan().toString() for t in ("o_orderkey", "c_custkey"))
    assert [label for label, df in written if scans(df)] == ["profile"] and not scans(out)
    sections = {r.section for r in out.select("section").distinct().collect()}
    assert sections == {"shape", "duplicates", "nulls", "missing", "describe", "category", "histogram", "box", "kde", "correlation"}


def test_report_of_awkward_columns(spark):
    df = spark.createDataFrame([(i, 5.0, None if i % 2 else float(i), float("nan"), "t") for i in range(9)], "k long, c double, h double, g double, t string")
    got = {(r.section, r.feature, r.stat): r.value for r in P.profile_report(df, "k").collect()}
    assert got["nulls", "h", "count"] == 4 and got["missing", "h", "rows"] == 4 and got["missing", "", "rows"] == 5
    assert got["describe", "c", "std"] == 0 and got["histogram", "c", "bin 6"] == 9 and ("kde", "c", "point 0") not in got
    assert got["correlation", "c", "h"] is None and got["box", "h", "median"] == 4 and ("describe", "g", "mean") not in got
    assert got["category", "t", "percent t"] == 100 and got["duplicates", "all", "count"] == 3
    assert P.profile_report(df.limit(0), "k").where("section = 'shape' and feature = 'rows'").first().value == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_spearman_by_look_up(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MAP_VALUES", most)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 700).astype(float), "b": rng.normal(size=700).round(1), "c": np.where(np.arange(700) % 3 == 0, 1.5, rng.normal(size=700))})
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(pdf.itertuples(index=False))], "k long, a double, b double, c double")
    out = R.spearman_matrix(df.repartition(5), "k", ["a", "b", "c"])
    got = {(r.col_a, r.col_b): r["corr"] for r in out.collect()}
    ref = pdf.corr("spearman")
    assert all(got[x, y] == pytest.approx(ref.loc[x, y]) for x in "abc" for y in "abc")


def test_short_columns_are_ranked_in_place(spark):
    """No row is shuffled when every column has few values."""
    df = spark.range(2000).selectExpr("id", "double(id % 7) as a", "double(id % 11) as b")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = exchanges(R.spearman_pairs(df, "id", [("a", "b")]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] or plan.count("hashpartitioning(a") == 0
    assert "_key" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_moments_of_pairs(spark):
    """Against pandas: missing values, infinities, columns that do not vary, many parts, a large mean."""
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"a": rng.normal(size=n) + 1e9, "b": rng.integers(0, 9, n).astype(float), "c": np.full(n, 0.1),
                        "d": np.where(np.arange(n) % 7 == 0, np.nan, rng.normal(size=n)), "e": np.full(n, np.nan), "f": rng.normal(size=n)})
    pdf.loc[5, "f"] = np.inf
    pdf["g"] = np.where(pdf["d"].isna(), pdf["a"], 0.3)        # does not vary where d is present
    rows = [tuple(None if i % 2 and np.isnan(v) else float(v) for v in r) for i, r in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf)).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r.feature, r.item): r for r in M.pair_moments(df, list(pdf), Stages(spark)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any("e" in k for k in got) and len(got) == 6 + 15
    for c in "abcdfg":
        v, r = pdf[c].dropna(), got[c, None]
        assert (r.n, r.low, r.high) == (len(v), v.min(), v.max()) and r["mean"] == pytest.approx(v.mean())
        assert r.sd is None if c == "f" else r.sd == pytest.approx(v.std(), rel=1e-7, abs=0)
    assert got["c", None].sd == 0 and got["d", "g"].vy == 0 and got["g", None].sd > 1
    for x, y in [("a", "b"), ("a", "d"), ("b", "d"), ("a", "c")]:
        both = pdf[[x, y]].dropna()
        assert got[x, y].n == len(both) and got[x, y].cxy == pytest.approx(both.cov().loc[x, y], rel=1e-7, abs=1e-7)
        assert (got[x, y].vx, got[x, y].vy) == (pytest.approx(both[x].var(), rel=1e-7), pytest.approx(both[y].var(), rel=1e-7))
    assert np.isnan(got["a", "f"].cxy) and np.isnan(got["a", "f"].vy) and got["a", "f"].vx > 0
    one = M.pair_moments(df.limit(1), ["a", "b"], Stages(spark)).where("item is not null").first()
    assert (one.n, one.cxy, one.vx, one.vy) == (1, None, None, None)
    assert M.pair_moments(df.limit(0), ["a", "b"], Stages(spark)).collect() == []


def test_report_makes_no_row_per_pair_and_one_image_per_value(spark, monkeypatch):
    """No pass turns a row into a row per pair of columns; joins and filters do not work the image out again."""
    plans = []
    monkeypatch.setattr(Stages, "write", lambda self, df, label="stage", f=Stages.write: plans.append(
        (label, df._jdf.queryExecution().optimizedPlan().toString())) or f(self, df, label))
    df = spark.range(60).selectExpr("id as k", "id / 7 as a", "id % 5 / 3 as b", "cast(id % 3 as string) as t")
    P.profile_report(df, "k")
    lines = [line for _, plan in plans for line in plan.split("\n")]
    assert [label for label, _ in plans].count("cuts") > 1
    assert not [line for line in lines if "Generate" in line and "pair" in line]
    assert not [line for line in lines if ("Join" in line or "Filter" in line) and "LOG2(" in line]
