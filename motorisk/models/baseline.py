"""Mean baselines (M5): the training mean of the label, optionally per level
of one categorical column (the fitted means are the model state; an unseen
or missing level gets the overall mean).

The level table is a DataFrame of any length, saved with the model and joined
to the rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .tables import TableModel


class _MeanParams(HasLabelCol, HasPredictionCol):
    groupCol = Param(Params._dummy(), "groupCol", "optional category column", TypeConverters.toString)


class MeanRegressor(Estimator, _MeanParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction", groupCol=""):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", groupCol="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MeanModel":
        y = F.col(self.getLabelCol()).cast("double")
        group = self.getOrDefault(self.groupCol)
        g = F.col(group).cast("string") if group else F.lit(None).cast("string")
        # one pass over the rows; the overall mean is summed from the level rows
        rows = df.groupBy(g.alias("level")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
        if group:
            rows = materialize(rows, "levels")
        total, count = rows.agg(F.sum("s"), F.sum("n")).first()
        table = None
        if group:
            table = rows.where("level is not null and n > 0").select("level", (F.col("s") / F.col("n")).alias("mean"))
        return self._copyValues(MeanModel(overall=float(total) / count if count else float("nan"), table=table))


class MeanModel(TableModel, Model, _MeanParams):
    overall = Param(Params._dummy(), "overall", "training mean", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, overall=0.0, table=None, labelCol="label", predictionCol="prediction", groupCol=""):
        super().__init__()
        self._setDefault(overall=0.0, labelCol="label", predictionCol="prediction", groupCol="")
        kw = dict(self._input_kwargs)
        self.table = kw.pop("table", None)
        self._set(**kw)

    def has_table(self) -> bool:
        return bool(self.getOrDefault(self.groupCol))

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        overall = F.lit(g(self.overall)).cast("double")
        if self.table is None:
            return df.withColumn(g(self.predictionCol), overall)
        table = self.table.select(F.col("level").alias("_level"), F.col("mean").alias("_mean"))
        return (df.join(table, F.col(g(self.groupCol)).cast("string") == F.col("_level"), "left")
                .withColumn(g(self.predictionCol), F.coalesce("_mean", overall)).drop("_level", "_mean"))
