"""Fitted models whose state holds a table.

The table is a DataFrame of any length, saved as Parquet next to the
parameters and joined in ``transform``; which join is left to adaptive
execution. Nothing of it reaches the driver.
"""

from __future__ import annotations

import os

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        if self.instance.table is not None:
            self.instance.table.write.mode("overwrite").parquet(os.path.join(path, "table"))


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.has_table():
            model.table = SparkSession.getActiveSession().read.parquet(os.path.join(path, "table"))
        return model


class TableModel(MLWritable, MLReadable):
    """Mixin: ``table`` is saved and loaded with the model."""

    table: DataFrame | None = None

    def has_table(self) -> bool:
        return True

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table = self.table
        return that
