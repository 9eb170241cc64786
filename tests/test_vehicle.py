"""U3 / F12 / F16 on FIXTURES F-7."""

import math

import pytest
from pyspark.sql import functions as F

from motorisk.features.transformers import VehicleFeatures, VehicleFeaturesModel

F7 = [(1, "Petrol", 15000.0, 4), (2, "Diesel", 25000.0, 4), (3, "Petrol", 8000.0, 2), (4, "LPG", 12000.0, 4),
      (5, "Diesel", 30000.0, 4)]


@pytest.fixture
def vehicle_df(spark):
    return spark.createDataFrame(F7, "policy_key int, Type_fuel string, Value_vehicle double, N_doors int")


def test_codes_by_first_appearance(vehicle_df):
    model = VehicleFeatures().fit(vehicle_df)
    assert [r.level for r in model.table.orderBy("code").collect()] == ["Petrol", "Diesel", "LPG"]
    out = model.transform(vehicle_df).orderBy("policy_key")
    assert [r[0] for r in out.select("fuel_type_encoded").collect()] == [0, 1, 0, 2, 1]


def test_unseen_and_null_get_minus_one(spark, vehicle_df):
    model = VehicleFeatures().fit(vehicle_df)
    other = spark.createDataFrame([(9, "Hybrid", 1.0, 4), (10, None, 1.0, 4)], vehicle_df.schema)
    assert [r[0] for r in model.transform(other).select("fuel_type_encoded").collect()] == [-1, -1]


def test_log_values(vehicle_df):
    out = VehicleFeatures().fit(vehicle_df).transform(vehicle_df).orderBy("policy_key").collect()
    assert out[0]["Value_vehicle_log_transformed"] == pytest.approx(math.log(15000.0))


@pytest.mark.parametrize("bad", [0.0, -100.0])
def test_non_positive_value_raises(spark, bad):
    df = spark.createDataFrame([(1, "Petrol", bad, 4)], "policy_key int, Type_fuel string, Value_vehicle double, N_doors int")
    model = VehicleFeatures().fit(df)
    with pytest.raises(ValueError, match="zero or negative"):
        model.validate(df)
    with pytest.raises(Exception, match="zero or negative"):
        model.transform(df).select("Value_vehicle_log_transformed").collect()


def test_missing_value_passes(spark):
    df = spark.createDataFrame([(1, "Petrol", None, 4)], "policy_key int, Type_fuel string, Value_vehicle double, N_doors int")
    assert VehicleFeatures().fit(df).transform(df).first()["Value_vehicle_log_transformed"] is None


def test_save_and_load(vehicle_df, tmp_path):
    model = VehicleFeatures().fit(vehicle_df)
    model.write().overwrite().save(str(tmp_path / "veh"))
    again = VehicleFeaturesModel.load(str(tmp_path / "veh"))
    assert [r.level for r in again.table.orderBy("code").collect()] == ["Petrol", "Diesel", "LPG"]
    assert again.transform(vehicle_df).where(F.col("fuel_type_encoded") == 2).count() == 1


def test_a_hundred_thousand_levels(spark):
    df = spark.range(100_000).select(F.col("id").alias("policy_key"), F.concat(F.lit("f"), F.col("id")).alias("Type_fuel"),
                                     F.lit(1.0).alias("Value_vehicle"))
    out = VehicleFeatures().fit(df).transform(df)
    assert out.where("fuel_type_encoded <> policy_key").count() == 0 and out.count() == 100_000
