"""Modelling dataset (J1, A1, A2): amounts as keys and sums, missing keys, column order."""

import pytest
from motorisk.operators.dataset import claim_target, modelling_dataset
from motorisk.operators.histograms import band_table

CLAIMS = [(1, 0.1 + 0.2, 10.10), (1, 0.3, 0.2), (1, 0.3, None), (2, 5.0, 1.0), (None, 5.0, 7.0), (2, float("nan"), 9.0), (2, float("inf"), 9.0), (3, 1.0, 0.0)]
POLICIES = [("a", 1, 0.3), ("b", 2, 5.0), ("c", 2, float("nan")), ("d", None, 5.0), ("e", 3, 1.0), ("f", 1, 0.3), ("g", 9, None)]


@pytest.fixture
def frames(spark):
    return (spark.createDataFrame(POLICIES, "policy string, ID long, Cost_claims_year double"),
            spark.createDataFrame(CLAIMS, "ID long, Cost_claims_year double, Cost_claims_by_type double"))


def test_amounts_that_differ_in_their_last_bits_are_one_key(frames):
    policies, claims = frames
    got = modelling_dataset(policies, claims, "count")
    assert got.columns == [*policies.columns, "claims_frequency"]
    assert {r.policy: r.claims_frequency for r in got.collect()} == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 1, "f": 2, "g": 0}


def test_costs_are_summed_in_whole_units(frames):
    policies, claims = frames
    got = {r.policy: (r.Cost_claims_by_type, r.claims_frequency) for r in modelling_dataset(policies, claims, "flag").collect()}
    assert got == {"a": (10.3, 1), "b": (1.0, 1), "c": (0.0, 0), "d": (0.0, 0), "e": (0.0, 0), "f": (10.3, 1), "g": (0.0, 0)}


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 1.0, x) for x in [0.1] * 1000 + [1e9, 0.07]]
    for part in (1, 7):
        df = spark.createDataFrame(rows, "ID long, Cost_claims_year double, Cost_claims_by_type double").repartition(part)
        assert claim_target(df, how="sum", out="s").first().s == 1000000100.07


def test_key_types_may_differ_between_the_sides(spark):
    policies = spark.createDataFrame([(1, 2.5), (2, 2.5)], "ID long, Cost_claims_year double")
    claims = spark.createDataFrame([(1.0, 2.5, 1.0), (float("nan"), 2.5, 1.0)], "ID double, Cost_claims_year double, Cost_claims_by_type double")
    assert {r.ID: r.claims_frequency for r in modelling_dataset(policies, claims).collect()} == {1: 1, 2: 0}


def test_wrong_choices_and_empty_sides(frames):
    policies, claims = frames
    with pytest.raises(ValueError):
        modelling_dataset(policies, claims, "mean")
    with pytest.raises(ValueError):
        claim_target(claims, how="mean")
    assert {r.claims_frequency for r in modelling_dataset(policies, claims.where("false")).collect()} == {0}
    assert modelling_dataset(policies.where("false"), claims).collect() == []


def test_band_table_reads_its_input_once(spark):
    df = spark.createDataFrame([(1.0, 1), (1.5, 0), (30.0, 1), (None, 1), (float("-5"), 0)], "x double, y int")
    table = band_table(df, "x", "y", edges=(0.0, 2.0, 10.0, 50.0), labels=("low", "mid", "high"))
    got = {r.band: (r.band_order, r.claims_rate, r["count"], r.total_claims, r.base_rate, r.lift) for r in table.collect()}
    assert got == {"low": (1, 0.5, 2, 1, 0.6, 0.8333), "mid": (2, None, 0, 0, 0.6, None), "high": (3, 1.0, 1, 1, 0.6, 1.6667)}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    empty = band_table(df.where("false"), "x", "y", edges=(0.0, 2.0), labels=("low",)).collect()
    assert [tuple(r) for r in empty] == [("low", 1, None, 0, 0, None, None)]
