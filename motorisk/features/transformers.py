"""Feature stages as ``pyspark.ml`` stages (U1–U3), savable inside a Pipeline.

Every stage is made of native column expressions: no Python worker runs
during ``transform``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..models.tables import TableModel
from ..operators.materialize import materialize
from ..operators.ordering import row_index

class FeatureTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the feature stages. ``_transform`` is abstract, so the base
    itself cannot be built; subclasses are saved and loaded with the pipeline."""


class DriverFeatures(FeatureTransformer):
    """Parse every ``Date*`` column, then driver age at the last renewal,
    driving experience, the gap between both and gap / age."""

    datePrefix = Param(Params._dummy(), "datePrefix", "prefix of text date columns",
                       TypeConverters.toString)
    dateFormat = Param(Params._dummy(), "dateFormat", "strftime format of the text dates",
                       TypeConverters.toString)
    renewalCol = Param(Params._dummy(), "renewalCol", "date of last renewal", TypeConverters.toString)
    birthCol = Param(Params._dummy(), "birthCol", "date of birth", TypeConverters.toString)
    licenceCol = Param(Params._dummy(), "licenceCol", "date of driving licence", TypeConverters.toString)
    ageCol = Param(Params._dummy(), "ageCol", "output: driver age", TypeConverters.toString)
    experienceCol = Param(Params._dummy(), "experienceCol", "output: experience", TypeConverters.toString)
    gapCol = Param(Params._dummy(), "gapCol", "output: |age - experience|", TypeConverters.toString)
    ratioCol = Param(Params._dummy(), "ratioCol", "output: gap / age", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, datePrefix="Date", dateFormat=D.DAY_FIRST_FORMAT,
                 renewalCol="Date_last_renewal", birthCol="Date_birth",
                 licenceCol="Date_driving_licence",
                 ageCol="driver_age_at_contract_inception",
                 experienceCol="driver_experience_age",
                 gapCol="driver_age_experience_age_diff",
                 ratioCol="driver_age_experience_ratio_proxy_for_driving_experience"):
        super().__init__()
        self._setDefault(datePrefix="Date", dateFormat=D.DAY_FIRST_FORMAT,
                         renewalCol="Date_last_renewal", birthCol="Date_birth",
                         licenceCol="Date_driving_licence",
                         ageCol="driver_age_at_contract_inception",
                         experienceCol="driver_experience_age",
                         gapCol="driver_age_experience_age_diff",
                         ratioCol="driver_age_experience_ratio_proxy_for_driving_experience")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        cols = D.columns_with_prefix(df, g(self.datePrefix))
        df = D.convert_columns_to_date(df, cols, g(self.dateFormat))
        df = D.abs_year_difference(df, g(self.renewalCol), g(self.birthCol), g(self.ageCol))
        df = D.abs_year_difference(df, g(self.renewalCol), g(self.licenceCol), g(self.experienceCol))
        age, exp = F.col(g(self.ageCol)), F.col(g(self.experienceCol))
        df = df.withColumn(g(self.gapCol), F.abs(age - exp))
        return df.withColumn(g(self.ratioCol), N.ratio(g(self.gapCol), g(self.ageCol)))


class _VehicleParams(Params):
    fuelCol = Param(Params._dummy(), "fuelCol", "fuel type column", TypeConverters.toString)
    fuelCodeCol = Param(Params._dummy(), "fuelCodeCol", "output: fuel code", TypeConverters.toString)
    valueCol = Param(Params._dummy(), "valueCol", "vehicle value", TypeConverters.toString)
    logValueCol = Param(Params._dummy(), "logValueCol", "output: log of value", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol",
                     "row key that defines first appearance of a fuel type", TypeConverters.toString)

    def _vehicle_defaults(self):
        self._setDefault(fuelCol="Type_fuel", fuelCodeCol="fuel_type_encoded",
                         valueCol="Value_vehicle", logValueCol="Value_vehicle_log_transformed",
                         orderCol="policy_key")


class VehicleFeatures(Estimator, _VehicleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fuel codes by first appearance (fitted on the training frame) and
    the guarded log of the vehicle value."""

    @keyword_only
    def __init__(self, *, fuelCol="Type_fuel", fuelCodeCol="fuel_type_encoded",
                 valueCol="Value_vehicle", logValueCol="Value_vehicle_log_transformed",
                 orderCol="policy_key"):
        super().__init__()
        self._vehicle_defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "VehicleFeaturesModel":
        fuel, order = self.getOrDefault(self.fuelCol), self.getOrDefault(self.orderCol)
        # one row per distinct level, numbered by first appearance: the fitted state
        firsts = (df.where(F.col(fuel).isNotNull()).groupBy(F.col(fuel).cast("string").alias("level"))
                  .agg(F.min(order).alias("first")))
        table = row_index(firsts, ["first", "level"], "code").select("level", F.col("code").cast("int").alias("code"))
        return self._copyValues(VehicleFeaturesModel(table=materialize(table, "levels")))


class VehicleFeaturesModel(TableModel, Model, _VehicleParams):
    @keyword_only
    def __init__(self, *, table=None, fuelCol="Type_fuel", fuelCodeCol="fuel_type_encoded",
                 valueCol="Value_vehicle", logValueCol="Value_vehicle_log_transformed",
                 orderCol="policy_key"):
        super().__init__()
        self._vehicle_defaults()
        kw = dict(self._input_kwargs)
        self.table = kw.pop("table", None)
        self._set(**kw)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        value = g(self.valueCol)
        table = self.table.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        return (df.join(table, F.col(g(self.fuelCol)).cast("string") == F.col("_level"), "left")
                .withColumns({g(self.fuelCodeCol): F.coalesce("_code", F.lit(-1)), g(self.logValueCol): N.log_positive(value, value)})
                .drop("_level", "_code"))

    def validate(self, df: DataFrame) -> None:
        """Fail eagerly when the value column has a value <= 0."""
        N.validate_positive(df, self.getOrDefault(self.valueCol))


class NewClientFeatures(FeatureTransformer):
    """Features known at the first quote: driver age and experience in
    years to a fixed date, car age, power-to-weight and a fixed fuel code."""

    asOf = Param(Params._dummy(), "asOf", "reference date (ISO)", TypeConverters.toString)
    dateFormat = Param(Params._dummy(), "dateFormat", "strftime format of the text dates",
                       TypeConverters.toString)

    @keyword_only
    def __init__(self, *, asOf="2018-12-31", dateFormat=D.DAY_FIRST_FORMAT):
        super().__init__()
        self._setDefault(asOf="2018-12-31", dateFormat=D.DAY_FIRST_FORMAT)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from ..functions.decode import FUEL_CODE, decode

        as_of = D.as_of_date(self.getOrDefault(self.asOf))
        fmt = self.getOrDefault(self.dateFormat)
        df = df.withColumns({
            "Date_birth_dt": D.parse_date("Date_birth", fmt),
            "Date_driving_licence_dt": D.parse_date("Date_driving_licence", fmt),
            "power_to_weight": N.ratio("Power", "Weight"),
            "Car_age_years": D.abs_int_difference("Year_matriculation", F.year(as_of)),
            "Type_fuel_encoded": decode("Type_fuel", FUEL_CODE, None),
        })
        return df.withColumns({
            "Driver_age_years": D.years_between_days("Date_birth_dt", as_of),
            "Driver_experience_years": D.years_between_days("Date_driving_licence_dt", as_of),
        })


class CarAge(FeatureTransformer):
    """F6 as a pipeline stage: car age in whole years at a fixed year, from the
    registration year. A frame that carries the age itself, as a quote does,
    passes unchanged, so one saved pipeline serves training rows and quotes."""

    asOfYear = Param(Params._dummy(), "asOfYear", "year the age is counted to", TypeConverters.toInt)
    yearCol = Param(Params._dummy(), "yearCol", "registration year", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output: car age", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, asOfYear=2018, yearCol="Year_matriculation", outputCol="Car_age_years"):
        super().__init__()
        self._setDefault(asOfYear=2018, yearCol="Year_matriculation", outputCol="Car_age_years")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        if g(self.outputCol) in df.columns:
            return df
        return df.withColumn(g(self.outputCol), D.abs_int_difference(g(self.yearCol), g(self.asOfYear)).cast("int"))
