"""U2 / F7–F10 on FIXTURES F-5 and F-6."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel

from motorisk.features.transformers import DriverFeatures, FeatureTransformer
from motorisk.functions import numeric as N

F5 = [("01/06/2020", "01/06/1990", "01/06/2008", 100.0), ("15/03/2021", "15/03/1985", "15/03/2005", 250.0),
      ("28/12/2019", "28/12/1975", "28/12/1995", 50.0)]


@pytest.fixture
def driver_df(spark):
    return spark.createDataFrame(F5, "Date_last_renewal string, Date_birth string, "
                                     "Date_driving_licence string, claim_amount double")


def test_is_feature_transformer():
    assert isinstance(DriverFeatures(), FeatureTransformer)


def test_values(driver_df):
    out = DriverFeatures().transform(driver_df).orderBy("claim_amount").collect()
    by_amount = {r["claim_amount"]: r for r in out}
    assert [by_amount[a]["driver_age_at_contract_inception"] for a in (100.0, 250.0, 50.0)] == [30, 36, 44]
    assert [by_amount[a]["driver_experience_age"] for a in (100.0, 250.0, 50.0)] == [12, 16, 24]
    assert [by_amount[a]["driver_age_experience_age_diff"] for a in (100.0, 250.0, 50.0)] == [18, 20, 20]
    ratios = [by_amount[a]["driver_age_experience_ratio_proxy_for_driving_experience"] for a in (100.0, 250.0, 50.0)]
    assert [round(x, 4) for x in ratios] == [0.6, 0.5556, 0.4545]


def test_custom_names(driver_df):
    out = DriverFeatures(ageCol="age", ratioCol="r").transform(driver_df)
    assert "age" in out.columns and "r" in out.columns


def test_dates_parsed_other_columns_kept(driver_df):
    out = DriverFeatures().transform(driver_df)
    types = dict(out.dtypes)
    assert types["Date_birth"] == "date" and types["claim_amount"] == "double"
    assert dict(driver_df.dtypes)["Date_birth"] == "string"


def test_gap_never_negative(spark):
    df = spark.createDataFrame([(10, 20), (20, 10)], "a int, e int")
    vals = [r[0] for r in df.select((N.F.abs(N.F.col("a") - N.F.col("e")))).collect()]
    assert vals == [10, 10]


def test_division_by_zero(spark):
    df = spark.createDataFrame([(0, 10), (0, 0), (5, 10), (None, 1)], "age int, gap int")
    vals = [r[0] for r in df.select(N.ratio("gap", "age")).collect()]
    assert vals[0] == math.inf and math.isnan(vals[1]) and vals[2] == 2.0 and vals[3] is None


def test_saved_in_pipeline(spark, driver_df, tmp_path):
    model = Pipeline(stages=[DriverFeatures(ageCol="age_x")]).fit(driver_df)
    path = str(tmp_path / "pipe")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert again.transform(driver_df).select("age_x").count() == 3


def test_base_cannot_be_built_and_subclass_must_transform(driver_df):
    with pytest.raises(TypeError):
        FeatureTransformer()

    class NoTransform(FeatureTransformer):
        pass

    with pytest.raises(TypeError):
        NoTransform()

    class Identity(FeatureTransformer):
        def _transform(self, df):
            return df

    assert Identity().transform(driver_df).count() == 3
