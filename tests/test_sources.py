"""S1–S4, S6, S8 (FIXTURES F-1, F-11)."""

import pytest
from pyspark.sql import types as T

from motorisk.sources import runlog as L
from motorisk.sources.files import load_delimited, parse_requests, read_csv, write_csv
from motorisk.streaming.scoring import QUOTE_SCHEMA

F1 = """ID;Date_birth;Date_driving_licence;Cost_claims_year;Power;Length;Weight
1;01/01/1980;01/01/2000;100;110;4.5;1200
2;02/02/1985;02/02/2005;0;90;NA;1100
3;03/03/1990;03/03/2010;250;150;4.2;1300
4;04/04/1975;04/04/1995;0;75;3.9;1000
"""

SCHEMA = ("ID int, Date_birth string, Date_driving_licence string, Cost_claims_year int, Power int, "
          "Length double, Weight int")


def test_load_delimited(spark, tmp_path):
    p = tmp_path / "policies.csv"
    p.write_text(F1)
    df = load_delimited(spark, str(p), SCHEMA)
    assert (df.count(), len(df.columns)) == (4, 7)
    assert df.where("Length IS NULL").count() == 1
    types = dict(df.dtypes)
    assert types["Power"] == "int" and types["Weight"] == "int" and types["Length"] == "double"


def test_na_token_in_text_column(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a;b\n"NA";1\nx;NA\n"";2\n')
    df = load_delimited(spark, str(p), "a string, b int")
    assert df.where("a IS NULL").count() == 2 and df.where("b IS NULL").count() == 1


def test_csv_round_trip(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.date(2020, 1, 2), 1.5), (2, None, None)], "k int, d date, v double")
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), "k int, d date, v double").orderBy("k").collect()
    assert back[0]["d"] == dt.date(2020, 1, 2) and back[1]["v"] is None


def test_metric_keys():
    assert [r[2] for r in L.metric_rows("r", {"mse": 0.5, "mae": 0.3}, "train")] == ["train/mse", "train/mae"]
    assert [r[2] for r in L.metric_rows("r", {"mse": 0.5}, "")] == ["mse"]
    assert [r[2] for r in L.metric_rows("r", {"mse": 0.5})] == ["mse"]
    assert L.metric_rows("r", {}, "train") == []


def test_run_log_round_trip(spark, tmp_path):
    log = L.RunLog(spark, str(tmp_path / "log"))
    log.log_parameters("a", {"alpha": 1.0})
    log.log_metrics_nested("a", {"mse": 0.5, "mae": 0.3}, "train")
    log.log_metrics_nested("a", {}, "test")
    got = {(r["kind"], r["key"]) for r in log.read("a").collect()}
    assert got == {("param", "alpha"), ("metric", "train/mse"), ("metric", "train/mae")}


def test_model_versions(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0,)], "x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f")]).fit(df)
    store = str(tmp_path / "store")
    assert L.register_model(spark, model, None, "r0") is None
    assert L.register_model(spark, model, store, "r1") == 1
    assert L.register_model(spark, model, store, "r2") == 2
    assert sorted(r[0] for r in L.model_versions(spark, store).select("version").collect()) == [1, 2]


def test_parse_requests_rejects(spark):
    df = spark.createDataFrame([
        (1, '{"Car_age_years": 3, "Type_risk": 2, "Area": 1, "Value_vehicle": 1000.5, "Distribution_channel": 0}'),
        (2, '{"Car_age_years": 3, "Type_risk": 2'),
        (3, '{"Car_age_years": "x", "Type_risk": 2, "Area": 1, "Value_vehicle": 1.0, "Distribution_channel": 0}'),
    ], "quote_id long, body string")
    ok, bad = parse_requests(df, "body", QUOTE_SCHEMA)
    assert [r["quote_id"] for r in ok.collect()] == [1]
    assert sorted(r["quote_id"] for r in bad.collect()) == [2, 3]
    assert isinstance(ok.schema["Value_vehicle"].dataType, T.DoubleType)


def test_drop_unknown_column_raises(spark):
    from motorisk.plans.premium import drop_columns
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert drop_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(KeyError):
        drop_columns(df, ["zzz"])


def test_export_premium_dataset(spark, tmp_path):
    from motorisk.plans.premium import export_premium_dataset
    from motorisk.sources import adapter as A
    pol = A.policies(spark, "/root/testdata/sf0.001")
    export_premium_dataset(pol, str(tmp_path / "prem"))
    back = spark.read.option("header", True).csv(str(tmp_path / "prem"))
    assert back.count() == pol.count() and "ID" not in back.columns and "Type_risk" in back.columns
    assert back.where("Date_birth RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() > 0


def test_pluggable_reader(spark, tmp_path):
    p = tmp_path / "pipe.txt"
    p.write_text("a|b\n1|NA\n2|x\n")

    def pipe_reader(spark, path, text_schema, delimiter):
        return spark.read.schema(text_schema).option("header", True).option("sep", "|").csv(path)

    df = load_delimited(spark, str(p), "a int, b string", reader=pipe_reader)
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, None), (2, "x")]


def test_wrong_fields_fail_or_are_counted(spark, tmp_path):
    from motorisk.sources.files import bad_fields
    (tmp_path / "x.csv").write_text("a;b\n1;u\n1x;v\nNA;w\n2.5;z\n")
    path, schema = str(tmp_path / "x.csv"), "a int, b string"
    with pytest.raises(Exception, match="column a"):
        load_delimited(spark, path, schema).collect()
    assert [r.a for r in load_delimited(spark, path, schema, strict=False).orderBy("b").collect()] == [1, None, None, None]
    assert {r.column: r.n_bad for r in bad_fields(spark, path, schema).collect()} == {"a": 2, "b": 0}
