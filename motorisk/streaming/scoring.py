"""Quote scoring in batch (G7) and as a stream (T1) with one saved pipeline.

A quote arrives as JSON text in an envelope with its id. Text that does not
parse, or lacks a field, is rejected (kept with status ``rejected``) rather
than failing the job. Quotes go through the saved ``PipelineModel`` (whatever stages it
holds), the same object in batch and stream, so there is
no training/serving skew.

The stream runs in append mode, and its checkpoint folder makes it restartable.
A quote that is delivered again (same id; without an id, the same text) within
``replay_window`` of its first arrival is scored once: the only state is the ids
of that window. The model is either given, or a store of published versions, of
which every micro-batch takes the newest.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.runlog import load_model, newest_model

# The request fields of a quote.
QUOTE_SCHEMA = T.StructType([
    T.StructField("Car_age_years", T.IntegerType()),
    T.StructField("Type_risk", T.IntegerType()),
    T.StructField("Area", T.IntegerType()),
    T.StructField("Value_vehicle", T.DoubleType()),
    T.StructField("Distribution_channel", T.IntegerType()),
])
ENVELOPE_SCHEMA = "quote_id long, body string"
SCORED, REJECTED = "scored", "rejected"


def score_quotes(model: PipelineModel, quotes: DataFrame, id_col: str = "quote_id", body_col: str = "body",
                 prediction: str = "prediction") -> DataFrame:
    """(quote_id, status, prediction) for every quote; NULL for rejects.

    One pass: every quote is parsed once and goes through the model, and the
    status decides whether the prediction counts."""
    request = F.from_json(F.col(body_col), QUOTE_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.lit(True)
    for f in QUOTE_SCHEMA.fields:
        ok = ok & F.col(f.name).isNotNull()
    rows = quotes.select(id_col, request.alias("_request")).select(id_col, "_request.*").withColumn("_ok", ok)
    # a rejected quote goes through with zeros; its prediction does not count
    scored = model.transform(rows.fillna(0, [f.name for f in QUOTE_SCHEMA.fields]))
    return scored.select(id_col, F.when(F.col("_ok"), SCORED).otherwise(REJECTED).alias("status"),
                         F.when(F.col("_ok"), F.col(prediction).cast("double")).alias("prediction"))


def once(quotes: DataFrame, replay_window: str = "1 hour") -> DataFrame:
    """Quotes read from files, each once. A file's time of change is the arrival
    of its quotes; ids are remembered until the watermark passes ``replay_window``."""
    arrived = quotes.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    told = F.when(F.col("quote_id").isNotNull(), F.concat(F.lit("id "), F.col("quote_id").cast("string"))).otherwise(
        F.concat(F.lit("text "), F.coalesce("body", "_corrupt_record", F.lit(""))))
    return (arrived.withColumn("_told", told).withWatermark("_arrived", replay_window)
            .dropDuplicatesWithinWatermark(["_told"]).select("quote_id", "body"))


def start_scoring_stream(spark: SparkSession, model: PipelineModel | str, source_dir: str, sink_dir: str,
                         checkpoint_dir: str, available_now: bool = True, max_files: int | None = None,
                         replay_window: str = "1 hour"):
    """JSON envelopes from a folder → scores appended as Parquet.

    ``model`` is a fitted pipeline, or the path of a store of published versions
    (S6): then each micro-batch is scored by the newest version, named in the
    column ``version``, and written to a folder of its own (``batch=N``), which a
    repeated attempt of that micro-batch replaces. A store without any version is an error.
    ``available_now`` processes what is there and stops (batch-like runs);
    otherwise the query keeps running on new files."""
    reader = spark.readStream.schema(f"{ENVELOPE_SCHEMA}, _corrupt_record string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = once(reader.json(source_dir), replay_window)
    if isinstance(model, str):
        writer = stream.writeStream.foreachBatch(lambda df, batch: _score_batch(df, batch, model, sink_dir))
    else:
        writer = score_quotes(model, stream).writeStream.format("parquet").option("path", sink_dir)
    writer = writer.option("checkpointLocation", checkpoint_dir).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _score_batch(df: DataFrame, batch: int, store: str, sink_dir: str) -> None:
    found = newest_model(df.sparkSession, store)
    if found is None:
        raise LookupError(f"no published model in {store}")
    version, path = found
    scored = score_quotes(load_model(path), df).withColumn("version", F.lit(version))
    scored.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={batch}"))
