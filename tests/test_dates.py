"""F1–F6, F11 on the reference's date fixtures (FIXTURES F-2, F-3, F-4)."""

import datetime as dt

import pytest

from motorisk.functions import dates as D

TEXT = [("01/06/2020", "01/06/2021", 100.0), ("15/03/2021", "15/03/2022", 250.0),
        ("28/12/2019", "28/12/2020", 50.0)]


@pytest.fixture
def text_df(spark):
    return spark.createDataFrame(TEXT, "inception_date string, expiry_date string, claim_amount double")


def test_parse_day_first(text_df):
    out = D.convert_columns_to_date(text_df, ["inception_date", "expiry_date"]).orderBy("claim_amount").collect()
    assert out[0]["inception_date"] == dt.date(2019, 12, 28)
    assert out[2]["expiry_date"] == dt.date(2022, 3, 15)


def test_other_columns_untouched(text_df):
    out = D.convert_columns_to_date(text_df, ["inception_date"])
    assert dict(out.dtypes)["expiry_date"] == "string"
    assert dict(out.dtypes)["claim_amount"] == "double"
    assert dict(text_df.dtypes)["inception_date"] == "string"   # input frame is not changed


def test_bad_text_becomes_null(spark):
    df = spark.createDataFrame([("01/06/2020",), ("not_a_date",), ("28/12/2019",)], "date_col string")
    vals = [r[0] for r in D.convert_columns_to_date(df, ["date_col"]).collect()]
    assert vals[1] is None and vals[0] == dt.date(2020, 6, 1)


def test_single_digit_day_and_invalid_day(spark):
    df = spark.createDataFrame([("1/6/2020",), ("31/02/2020",)], "d string")
    vals = [r[0] for r in df.select(D.parse_date("d")).collect()]
    assert vals == [dt.date(2020, 6, 1), None]


def test_iso_format(spark):
    df = spark.createDataFrame([("2020-06-01",), ("2021-03-15",)], "d string")
    out = D.convert_columns_to_date(df, ["d"], "%Y-%m-%d").collect()
    assert out[1]["d"] == dt.date(2021, 3, 15)


def test_strict_parse_raises(spark):
    df = spark.createDataFrame([("bad",)], "d string")
    with pytest.raises(Exception):
        df.select(D.parse_date_strict("d")).collect()


def test_extract_year_and_missing(spark):
    df = spark.createDataFrame([(dt.date(2020, 6, 1),), (None,), (dt.date(2019, 12, 28),)], "inception_date date")
    vals = [r["y"] for r in D.extract_year(df, "inception_date", "y").collect()]
    assert vals == [2020, None, 2019]


def test_abs_year_difference_order_independent(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 12, 31)),
                                (dt.date(2010, 5, 1), dt.date(2020, 5, 1))], "start_date date, end_date date")
    a = [r["d"] for r in D.abs_year_difference(df, "start_date", "end_date", "d").collect()]
    b = [r["d"] for r in D.abs_year_difference(df, "end_date", "start_date", "d").collect()]
    assert a == b == [0, 10]


def test_abs_year_difference_rejects_text(text_df):
    with pytest.raises(ValueError, match="a date or timestamp column is expected"):
        D.abs_year_difference(text_df, "inception_date", "expiry_date", "d")


def test_years_between_days_and_signed(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), dt.date(2018, 12, 31))], "a date, b date")
    r = df.select(D.years_between_days("a", "b").alias("y"), D.signed_year_difference("a", "b").alias("s")).first()
    assert r["y"] == pytest.approx(6939 / 365.25)
    assert r["s"] == -18


def test_spark_pattern():
    assert D.spark_pattern("%d/%m/%Y") == "d/M/yyyy"
    assert D.spark_pattern("%Y-%m-%d") == "yyyy-M-d"
