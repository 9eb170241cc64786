"""Publication of models by several writers, and the stream that uses it."""

import json
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from motorisk.sources import runlog as L
from motorisk.streaming.scoring import QUOTE_SCHEMA, start_scoring_stream

FIELDS = [f.name for f in QUOTE_SCHEMA.fields]


def model(spark, value):
    """Predicts ``value`` for every quote."""
    rows = spark.createDataFrame([(i, 1, 1, 1.0 * i, 1, float(value)) for i in range(4)], "Car_age_years int, Type_risk int, Area int, Value_vehicle double, Distribution_channel int, y double")
    return Pipeline(stages=[VectorAssembler(inputCols=FIELDS, outputCol="features"), LinearRegression(labelCol="y")]).fit(rows)


@pytest.fixture(scope="module")
def models(spark):
    return {v: model(spark, v) for v in (1, 2)}


def test_interleaved_publishers(spark, models, tmp_path):
    """Both read the store before either publishes: they get 1 and 2."""
    store = str(tmp_path / "s")
    paths = [L.save_model(m, f"{store}/models/m{v}", overwrite=False) for v, m in models.items()]
    seen = [L.next_version(spark, store) for _ in paths]
    assert seen == [1, 1]
    assert [L.publish(spark, store, p, "r", n) for p, n in zip(paths, seen)] == [1, 2]
    assert {(r.version, r.path) for r in L.model_versions(spark, store).collect()} == {(1, paths[0]), (2, paths[1])}
    assert L.newest_model(spark, store) == (2, paths[1])
    assert L.load_model(paths[1]).stages[-1].intercept == pytest.approx(2)


def test_many_publishers_at_once(spark, tmp_path):
    store, got = str(tmp_path / "s"), []
    start = threading.Barrier(8)

    def run(i):
        start.wait()
        got.append(L.publish(spark, store, f"p{i}", "r", 1))
    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(1, 9))
    assert sorted(r.version for r in L.model_versions(spark, store).collect()) == list(range(1, 9))


def test_failed_publication_leaves_the_version_free(spark, models, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    with monkeypatch.context() as m:
        m.setattr(L, "create_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            L.register_model(spark, models[1], store, "r")
    assert L.model_versions(spark, store).count() == 0
    assert L.register_model(spark, models[1], store, "r") == 1


def test_run_logged_again(spark, tmp_path):
    log = L.RunLog(spark, str(tmp_path / "log"))
    for _ in range(2):
        log.log_parameters("r", {"a": 1})
        log.log_metrics_nested("r", {"mse": 0.5}, "train")
        log.log_metrics_nested("r", {"mse": 0.7}, "test")
    assert sorted((r.kind, r.key, r.value, r.text) for r in log.read("r").collect()) == [
        ("metric", "test/mse", 0.7, None), ("metric", "train/mse", 0.5, None), ("param", "a", None, "1")]


def quote(i):
    return json.dumps({"quote_id": i, "body": json.dumps(dict(zip(FIELDS, (3, 1, 1, 9.0, 1))))})


def drain(spark, source, folder, src):
    q = start_scoring_stream(spark, source, str(src), str(folder / "out"), str(folder / "ckpt"))
    q.awaitTermination()


def test_replayed_quotes_and_new_version(spark, models, tmp_path):
    store, src = str(tmp_path / "s"), tmp_path / "in"
    src.mkdir()
    L.register_model(spark, models[1], store, "r1")
    first = "\n".join(quote(i) for i in range(5)) + "\nnot json\n"
    (src / "a.json").write_text(first)
    (src / "a-again.json").write_text(first)
    drain(spark, store, tmp_path, src)
    L.register_model(spark, models[2], store, "r2")
    (src / "b.json").write_text(first + quote(5) + "\n")
    drain(spark, store, tmp_path, src)
    got = sorted(((r.quote_id is None, r.quote_id or 0, r.status, r.prediction and round(r.prediction), r.version)
                  for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(False, i, "scored", 1, 1) for i in range(5)] + [(False, 5, "scored", 2, 2), (True, 0, "rejected", None, 1)]


def test_new_version_without_restart(spark, models, tmp_path):
    """A running query takes a version that is published while it runs."""
    import time
    store, src, out = str(tmp_path / "s"), tmp_path / "in", tmp_path / "out"
    src.mkdir()
    L.register_model(spark, models[1], store, "r1")
    (src / "a.json").write_text(quote(1) + "\n")
    q = start_scoring_stream(spark, store, str(src), str(out), str(tmp_path / "ckpt"), available_now=False)
    try:
        versions = lambda: {r.quote_id: r.version for r in spark.read.parquet(str(out)).collect()} if list(out.glob("batch=*/_SUCCESS")) else {}
        for want in (1, 2):
            if want == 2:
                L.register_model(spark, models[2], store, "r2")
                (src / "b.json").write_text(quote(2) + "\n")
            end = time.time() + 90
            while want not in versions() and time.time() < end:
                time.sleep(1)
        assert versions() == {1: 1, 2: 2} and q.isActive
    finally:
        q.stop()


def test_empty_store(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(quote(1) + "\n")
    with pytest.raises(Exception, match="no published model"):
        drain(spark, str(tmp_path / "none"), tmp_path, src)


def test_fixed_model(spark, models, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a", "b"):
        (src / f"{name}.json").write_text(quote(1) + "\n")
    drain(spark, models[2], tmp_path, src)
    assert [(r.quote_id, round(r.prediction)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]
