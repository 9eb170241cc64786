"""Drift counts on a stream (E2, streaming form).

Event-time tumbling windows with a watermark: state holds only the windows the
watermark has not passed. Counts are written in update mode, each micro-batch
to a folder of its own (so a repeated batch replaces itself); the latest count
of a (segment, window, bin) is its largest. So windows still open when the
input ends are in the result, too. Bin edges come from the baseline ranges, a
static frame joined to the stream; a segment without baseline gets the pooled
range. The PSI of each window is then ``psi_from_counts`` over the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import PSI_BINS, PSI_EPSILON, pooled_range, psi_bin, with_ranges


def start_drift_stream(spark: SparkSession, source_dir: str, schema, ranges: DataFrame, value: str, ts: str,
                       segment: str, sink_dir: str, checkpoint_dir: str, window: str = "1 day",
                       watermark: str = "1 day", k: int = PSI_BINS, available_now: bool = True):
    pooled = pooled_range(ranges)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    rows = stream.select(F.col(segment).alias("segment"), F.col(value).cast("double").alias("v"),
                         F.col(ts).cast("timestamp").alias("ts")).where(F.col("v").isNotNull())
    binned = with_ranges(rows, ranges, pooled).select(
        "segment", "ts", psi_bin(F.col("v"), F.col("lo"), F.col("hi"), k).alias("bin"))
    counts = (binned.withWatermark("ts", watermark)
              .groupBy("segment", F.window("ts", window).alias("w"), "bin").count()
              .select("segment", F.col("w.start").alias("window_start"), "bin", F.col("count").alias("n")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    writer = counts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint_dir).outputMode("update")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def stream_counts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Latest count of every (segment, window, bin) the stream has written."""
    return spark.read.parquet(sink_dir).groupBy("segment", "window_start", "bin").agg(F.max("n").alias("n"))


def psi_from_counts(counts: DataFrame, base_shares: DataFrame) -> DataFrame:
    """PSI per (segment, window) from emitted counts and baseline shares
    (segment, bin, p_base)."""
    totals = counts.groupBy("segment", "window_start").agg(F.sum("n").alias("_t"))
    live = counts.join(totals, ["segment", "window_start"]).select(
        "segment", "window_start", "bin", (F.col("n") / F.col("_t")).alias("p_live"))
    grid = (live.select("segment", "window_start").distinct()
            .join(base_shares.select("segment", "bin").unionByName(live.select("segment", "bin")).distinct(),
                  "segment"))
    full = (grid.join(base_shares, ["segment", "bin"], "left").join(live, ["segment", "window_start", "bin"], "left")
            .select("segment", "window_start",
                    F.greatest(F.coalesce("p_base", F.lit(0.0)), F.lit(PSI_EPSILON)).alias("pb"),
                    F.greatest(F.coalesce("p_live", F.lit(0.0)), F.lit(PSI_EPSILON)).alias("pl")))
    return full.groupBy("segment", "window_start").agg(
        F.sum((F.col("pl") - F.col("pb")) * F.ln(F.col("pl") / F.col("pb"))).alias("psi"))
