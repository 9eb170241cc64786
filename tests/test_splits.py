"""X1–X3 on FIXTURES F-8."""

import pytest
from pyspark.sql import functions as F

from motorisk.operators import splits as S


@pytest.fixture
def f8(spark):
    return spark.range(100).select(F.col("id").cast("int").alias("a"), (F.col("id") + 100).cast("int").alias("b"))


def test_exact_sizes(f8):
    out = S.split_data(f8, "a", 0.3, seed=42)
    train, test = S.train_test(out)
    assert (train.count(), test.count()) == (70, 30)
    assert out.count() == 100


@pytest.mark.parametrize("ratio", [0.0, 1.0, -0.5])
def test_bad_ratio(f8, ratio):
    with pytest.raises(ValueError):
        S.split_data(f8, "a", ratio)


def test_reproducible(f8):
    a = {r[0] for r in S.train_test(S.split_data(f8, "a", 0.2, seed=99))[1].select("a").collect()}
    b = {r[0] for r in S.train_test(S.split_data(f8.repartition(7), "a", 0.2, seed=99))[1].select("a").collect()}
    c = {r[0] for r in S.train_test(S.split_data(f8, "a", 0.2, seed=1))[1].select("a").collect()}
    assert a == b and a != c


def test_no_shuffle_keeps_last_rows(f8):
    test = S.train_test(S.split_data(f8, "a", 0.2, shuffle=False))[1]
    assert sorted(r[0] for r in test.select("a").collect()) == list(range(80, 100))


def test_ordered_split(f8):
    out = S.split_ordered(f8, ["b"], "a", 0.2)
    assert out.where("split = 'train'").agg(F.max("a")).first()[0] == 79


def test_shuffle_order_is_permutation(f8):
    pos = [r[0] for r in S.shuffle_order(f8, "a", 42).select("shuffle_position").collect()]
    assert sorted(pos) == list(range(100))


def test_empty_train_set_raises(spark):
    one = spark.range(1).select(F.col("id").alias("a"))
    with pytest.raises(ValueError, match="train set would be empty"):
        S.split_data(one, "a", 0.2)
    with pytest.raises(ValueError):
        S.split_data(one.where("a < 0"), "a", 0.2)


def test_split_moves_no_row(spark, f8):
    """The labelled frame's plan holds no exchange: rows are compared where they lie."""
    for out in (S.split_data(f8, "a", 0.3), S.split_ordered(f8, ["b"], "a", 0.3), S.split_data(f8, "a", 0.3, shuffle=False)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_cells_are_refined(spark, monkeypatch):
    monkeypatch.setattr(S, "SORTED_ROWS", 0)
    df = spark.range(3000).select(F.col("id").alias("a"))
    want = {r.a for r in S.shuffle_order(df, "a", 5).where("shuffle_position < 900").collect()}
    got = {r.a for r in S.split_data(df, "a", 0.3, seed=5).where("split = 'test'").collect()}
    assert got == want


def test_ordered_split_with_missing_values(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 7)) for i in range(60)], "a int, o double")
    out = S.split_ordered(df, ["o"], "a", 0.25)
    train = [tuple(r)[:2] for r in out.where("split = 'train'").collect()]
    key = lambda r: (r[1] is not None, r[1] or 0, r[0])
    assert sorted(train, key=key) == sorted(((r.a, r.o) for r in df.collect()), key=key)[:45]
