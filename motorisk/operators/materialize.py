"""Write a frame once to the shared checkpoint folder and read it back.

Operators that pass over their input several times (ranking, quantiles,
metrics with an exact median, splits) call this on the narrow projection
they need, so the upstream plan (scans, joins, aggregates) runs once instead
of once per pass, and the lineage is cut at a table on shared storage: a
lost executor never forces the upstream to be replayed.

``Stages`` owns the tables one operator call writes: ``drop`` deletes those
that nothing later reads. A frame that a lazy result reads stays until its
owner calls ``close`` (or the checkpoint folder is cleared).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import scratch_dir


class Stages:
    """Tables written to the shared checkpoint folder by one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: set[str] = set()

    def write(self, df: DataFrame, label: str = "stage") -> DataFrame:
        """Run ``df`` once; a reader of the stored result."""
        path = scratch_dir(self.spark, label)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.add(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Frames that are no stages of this object are left alone."""
        for f in frames:
            path = getattr(f, "_stage_path", None)
            if path in self._paths:
                self._paths.remove(path)
                self.remove(path)

    def close(self) -> None:
        for path in list(self._paths):
            self._paths.remove(path)
            self.remove(path)

    def remove(self, path: str) -> None:
        """Delete a folder on shared storage."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """A stage that a lazy result reads; the owner of the checkpoint folder removes it."""
    return Stages(df.sparkSession).write(df, label)
