"""Run log, model store and model versions.

A run log is a table of long rows (run_id, kind, key, value, text) in Parquet,
partitioned by ``run_id`` and logging call; parameters keep their text,
metrics their number. Metric names get a ``prefix/`` when a prefix is given.
Plot data (S7) are plain DataFrames written next to the log.

Logging the same frame again for a run replaces what that call wrote before.

Model versions: a model is saved in a folder of its own, and then published by
one manifest file per version, which names (version, run_id, path) and comes into
being complete and at once, or not at all when that version exists. The number
is the next free one (1 for an empty store); a publisher that finds it taken
tries the one after it, so several may publish at the same time, and one that
fails before its manifest file leaves an unused folder and no gap.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

MANIFEST_SCHEMA = "version int, run_id string, path string, created timestamp"


def metric_key(name: str, prefix: str = "") -> str:
    return f"{prefix}/{name}" if prefix else name


def metric_rows(run_id: str, metrics: Mapping[str, float], prefix: str = "") -> list[tuple]:
    """``log_metrics_nested`` as rows; an empty dict gives no row."""
    return [(run_id, "metric", metric_key(k, prefix), float(v), None) for k, v in metrics.items()]


def param_rows(run_id: str, params: Mapping[str, object]) -> list[tuple]:
    return [(run_id, "param", str(k), None, str(v)) for k, v in params.items()]


def metric_frame(run_id: str, metrics: DataFrame, name_col: str = "name", value_col: str = "value",
                 prefix_col: str | None = None) -> DataFrame:
    """Metrics that are already a DataFrame (from ``metrics_long``) as log rows,
    without bringing them to the driver."""
    key = F.col(name_col) if not prefix_col else F.concat_ws("/", F.col(prefix_col), F.col(name_col))
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), key.alias("key"),
                          F.col(value_col).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, run_id: str, part: str, df: DataFrame) -> None:
        """Rows of one logging call, in a folder that the same call replaces when a run is logged again."""
        df.drop("run_id").write.mode("overwrite").parquet(os.path.join(self.path, f"run_id={run_id}", f"part={part}"))

    def log_parameters(self, run_id: str, params: Mapping[str, object]) -> None:
        rows = param_rows(run_id, params)
        if rows:
            self._write(run_id, "params", self.spark.createDataFrame(rows, LOG_SCHEMA))

    def log_metrics_nested(self, run_id: str, metrics: Mapping[str, float] | DataFrame, prefix: str = "") -> None:
        """``prefix`` also tells one call of a run from another."""
        if isinstance(metrics, DataFrame):
            self._write(run_id, f"metrics-{prefix or 'all'}", metric_frame(run_id, metrics))
            return
        rows = metric_rows(run_id, metrics, prefix)
        if rows:
            self._write(run_id, f"metrics-{prefix or 'all'}", self.spark.createDataFrame(rows, LOG_SCHEMA))

    def log_model(self, run_id: str, model, name: str = "model") -> str:
        """The fitted pipeline saved next to the log, under the run."""
        return save_model(model, self.model_path(run_id, name))

    def model_path(self, run_id: str, name: str = "model") -> str:
        return os.path.join(self.path + "_models", run_id, name)

    def log_plot_data(self, run_id: str, frames: Mapping[str, DataFrame]) -> None:
        """The numbers behind each chart, one Parquet folder per chart."""
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(os.path.join(self.path + "_plots", run_id, name))

    def read(self, run_id: str | None = None) -> DataFrame:
        df = self.spark.read.schema(T.StructType([*LOG_SCHEMA.fields, T.StructField("part", T.StringType())])).parquet(self.path).drop("part")
        return df.where(F.col("run_id") == run_id) if run_id else df


def save_model(model, path: str, overwrite: bool = True) -> str:
    """Persist a fitted pipeline; without ``overwrite`` an existing folder is an error."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with its whole text; False, and nothing changed, if it
    exists already. The text is written beside it first and then gets its name in
    one step that does not replace: a hard link on a local disk, elsewhere a
    rename by the file system, which has to be atomic (HDFS is)."""
    target, fs = _path(spark, path)
    draft, _ = _path(spark, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-{uuid.uuid4().hex}"))
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        return bool(fs.rename(draft, target)) if not fs.exists(target) else False
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def _manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """Published versions; None for a store without any manifest."""
    mpath = os.path.join(store, "manifest")
    try:
        files = spark.read.schema(MANIFEST_SCHEMA).option("pathGlobFilter", "v*.json").option("mode", "FAILFAST").json(mpath)
        # tables written before versions had files of their own
        tables = spark.read.schema(MANIFEST_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(mpath)
    except AnalysisException as e:
        # only a missing path means an empty store; any other failure must not restart the numbering
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return files.unionByName(tables)


def next_version(spark: SparkSession, store: str) -> int:
    m = _manifest(spark, store)
    if m is None:
        return 1
    return int(m.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1


def publish(spark: SparkSession, store: str, path: str, run_id: str, version: int | None = None) -> int:
    """The version under which the model saved at ``path`` is published: ``version``
    (by default the next one) or, as long as that is taken, the one after it."""
    number = version or next_version(spark, store)
    while True:
        row = {"version": number, "run_id": run_id, "path": path, "created": _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}
        if create_once(spark, os.path.join(store, "manifest", f"v{number:08d}.json"), json.dumps(row) + "\n"):
            return number
        number += 1


def register_model(spark: SparkSession, model, store: str | None, run_id: str) -> int | None:
    """Publish ``model`` as the next version; skipped (None) without a store."""
    if not store:
        return None
    path = save_model(model, os.path.join(store, "models", f"{run_id}-{uuid.uuid4().hex[:12]}"), overwrite=False)
    return publish(spark, store, path, run_id)


def model_versions(spark: SparkSession, store: str) -> DataFrame:
    m = _manifest(spark, store)
    if m is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return m


def newest_model(spark: SparkSession, store: str) -> tuple[int, str] | None:
    """(version, path) of the newest published model; None when there is none."""
    row = model_versions(spark, store).orderBy(F.desc("version")).select("version", "path").first()
    return (row.version, row.path) if row else None
