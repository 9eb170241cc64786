"""Code-to-label decoding (F15, F18–F25) as CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHERS = "Others"

# Labels of the coded policy columns.
DISTRIBUTION_CHANNEL = {0: "Agent", 1: "Broker"}
PAYMENT = {0: "Half-yearly", 1: "Annually"}
TYPE_RISK = {1: "Motorbikes", 2: "Vans", 3: "Passenger Cars", 4: "Agricultural Vehicles"}
AREA = {0: "Rural", 1: "Urban"}
SECOND_DRIVER = {0: "No", 1: "Yes"}
TYPE_FUEL = {"P": "Petrol", "D": "Diesel"}

# Numeric fuel code of the new-client features (others -> missing).
FUEL_CODE = {"P": 0, "D": 1}

# Claim-count bins; counts above 25 share one bin.
CLAIM_BIN_MAX = 25
CLAIM_BIN_OVER = "25+"

PREMIUM_LABELS = {
    "Distribution_channel": DISTRIBUTION_CHANNEL,
    "Payment": PAYMENT,
    "Type_risk": TYPE_RISK,
    "Area": AREA,
    "Second_driver": SECOND_DRIVER,
    "Type_fuel": TYPE_FUEL,
}


def decode(col: str | Column, mapping: Mapping, default: object = OTHERS) -> Column:
    """Map codes to values; anything else, missing included, gets ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for code, label in mapping.items():
        expr = (F.when(c == F.lit(code), F.lit(label)) if expr is None
                else expr.when(c == F.lit(code), F.lit(label)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def decode_columns(df: DataFrame, mappings: Mapping[str, Mapping] = PREMIUM_LABELS) -> DataFrame:
    """Apply ``decode`` to several columns in one projection."""
    return df.withColumns({name: decode(name, m) for name, m in mappings.items()})


def claims_bin(col: str | Column) -> Column:
    """the count as text, or ``25+`` above 25."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c <= CLAIM_BIN_MAX, c.cast("string")).otherwise(F.lit(CLAIM_BIN_OVER))


def claims_bin_order(col: str | Column) -> Column:
    """Numeric sort key of ``claims_bin`` (``25+`` sorts after 25)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c <= CLAIM_BIN_MAX, c).otherwise(F.lit(CLAIM_BIN_MAX + 1)).cast("int")


def sql_decode(col: str, mapping: Mapping, default: object = OTHERS) -> str:
    """SQL twin of ``decode`` for the oracle queries."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"CASE {arms}{tail} END"
