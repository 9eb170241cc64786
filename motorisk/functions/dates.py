"""Date parsing and date arithmetic as native column expressions."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strftime directives and the Spark datetime pattern each maps to.
# Day and month accept one or two digits on parse, as the pandas parser does.
STRFTIME_TO_SPARK = {
    "%d": "d",
    "%m": "M",
    "%Y": "yyyy",
    "%y": "yy",
    "%H": "H",
    "%M": "m",
    "%S": "s",
    "%b": "MMM",
    "%B": "MMMM",
}

DAY_FIRST_FORMAT = "%d/%m/%Y"
DAYS_PER_YEAR = 365.25


def spark_pattern(date_format: str) -> str:
    """Translate a strftime format (``%d/%m/%Y``) into a Spark pattern (``d/M/yyyy``)."""
    out, i = [], 0
    while i < len(date_format):
        two = date_format[i:i + 2]
        if two in STRFTIME_TO_SPARK:
            out.append(STRFTIME_TO_SPARK[two])
            i += 2
        elif date_format[i].isalpha():
            out.append(f"'{date_format[i]}'")
            i += 1
        else:
            out.append(date_format[i])
            i += 1
    return "".join(out)


def parse_date(col: str | Column, date_format: str = DAY_FIRST_FORMAT) -> Column:
    """Tolerant parse: text that is not a valid date becomes NULL (F1)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(c.cast("string"), spark_pattern(date_format))


def parse_date_strict(col: str | Column, date_format: str = DAY_FIRST_FORMAT) -> Column:
    """Raising parse: a bad value fails the job under ANSI mode (F2)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c.cast("string"), spark_pattern(date_format))


def convert_columns_to_date(
    df: DataFrame, columns: Iterable[str], date_format: str = DAY_FIRST_FORMAT
) -> DataFrame:
    """F1 on a set of columns; other columns are untouched. Columns that are
    already dates are kept as they are."""
    mapping = {}
    types = dict(df.dtypes)
    for c in columns:
        if types[c] == "date":
            continue
        if types[c] in ("timestamp", "timestamp_ntz"):
            mapping[c] = F.to_date(F.col(c))
        else:
            mapping[c] = parse_date(c, date_format)
    return df.withColumns(mapping) if mapping else df


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Dynamic column set by name prefix (case-sensitive, like pandas)."""
    return [c for c in df.columns if c.startswith(prefix)]


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Dynamic column set by type: ``text``, ``numeric`` or ``date``."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if kind == "text" and isinstance(t, T.StringType):
            out.append(f.name)
        elif kind == "numeric" and isinstance(t, T.NumericType):
            out.append(f.name)
        elif kind == "date" and isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.append(f.name)
    return out


def _require_dates(df: DataFrame, *columns: str) -> None:
    ok = (T.DateType, T.TimestampType, T.TimestampNTZType)
    for c in columns:
        if not isinstance(df.schema[c].dataType, ok):
            raise ValueError("a date or timestamp column is expected on both sides")


def extract_year(df: DataFrame, date_column: str, out: str) -> DataFrame:
    """calendar year; missing stays missing."""
    return df.withColumn(out, F.year(date_column))


def abs_year_difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """|year(a) - year(b)|; both columns must be dates."""
    _require_dates(df, a, b)
    return df.withColumn(out, F.abs(F.year(a) - F.year(b)))


def signed_year_difference(a: str | Column, b: str | Column) -> Column:
    """year(a) - year(b), no absolute value."""
    return F.year(a) - F.year(b)


def years_between_days(start: str | Column, end: str | Column) -> Column:
    """whole days between two dates divided by 365.25."""
    return F.datediff(end, start).cast("double") / F.lit(DAYS_PER_YEAR)


def abs_int_difference(a: str | Column, b: str | Column | int) -> Column:
    """|a - b| for integers (car age from registration year)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.lit(b) if isinstance(b, int) else (F.col(b) if isinstance(b, str) else b)
    return F.abs(a - b)


def as_of_date(value: str | _dt.date) -> Column:
    """the reference date as a literal, so results are reproducible."""
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)
