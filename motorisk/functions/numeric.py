"""Numeric helpers with the reference's edge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where x/0 is +-inf and 0/0 is NaN (float division rules).

    Division by zero raises under ANSI mode, so the zero case is handled
    before dividing; NULL in either operand gives NULL."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    at_zero = F.when(n == 0, F.lit(NAN)).when(n > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def _not_positive(name: str) -> str:
    return f"cannot take the logarithm of {name}: zero or negative value found"


def log_positive(col: str | Column, name: str = "Value_vehicle") -> Column:
    """natural log that fails the job on a value <= 0 (missing passes)."""
    c = _c(col)
    return F.when(c <= 0, F.raise_error(F.lit(_not_positive(name))).cast("double")).otherwise(F.ln(c))


def validate_positive(df: DataFrame, column: str) -> None:
    """Eager check for F12: one aggregate action; raises ``ValueError``.

    The guard inside ``log_positive`` is pruned by the optimizer when the
    log column is never used, so callers that need the failure call this."""
    bad = df.select(F.count_if(F.col(column) <= 0).alias("n")).first()["n"]
    if bad:
        raise ValueError(_not_positive(column))


def log_or_null(col: str | Column) -> Column:
    """unguarded log; values <= 0 give NULL."""
    c = _c(col)
    return F.when(c > 0, F.ln(c))


def flag_at_least(col: str | Column, threshold: float = 1) -> Column:
    """(x >= threshold) as 0/1, missing -> 0."""
    return F.coalesce((_c(col) >= threshold).cast("int"), F.lit(0))


def flag_positive(col: str | Column) -> Column:
    """(x > 0) as 0/1, missing -> 0."""
    return F.coalesce((_c(col) > 0).cast("int"), F.lit(0))


def round_to(col: str | Column, digits: int = 4) -> Column:
    """F28."""
    return F.round(_c(col), digits)
