"""File sources and sinks (S1–S3, S8) and scratch folders on shared storage.

* ``load_delimited``: the reference's ``;``-separated policy files with a
  header and NA tokens. A fixed schema is required (inference would be a
  second pass and flips int/double when a column holds NA). Tokens inside
  text columns, quoted or not, also become NULL.
* ``write_csv`` / ``read_csv``: comma files with header and ISO dates.
* ``parse_requests``: JSON request text to typed rows; rows that do not
  parse or miss a required field go to a reject frame instead of failing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Text read as missing (the reference's tokens plus the usual
# defaults of its CSV reader).
NA_TOKENS = ("NA", "", "N/A", "NaN", "nan", "NULL", "null", "n/a", "<NA>", "None", "#N/A", "-NaN", "-nan")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the reliable checkpoint folder (shared storage on
    a cluster), for files a job writes and reads back."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "motorisk-work", f"{name}-{uuid.uuid4().hex[:12]}")


def spark_text_reader(spark: SparkSession, path: str, text_schema: T.StructType, delimiter: str) -> DataFrame:
    """Default reader of ``load_delimited``: Spark's CSV scan, every field as text."""
    return (spark.read.schema(text_schema).option("header", True).option("sep", delimiter)
            .option("mode", "PERMISSIVE").csv(path))


def _fields(raw: DataFrame, schema: T.StructType, na_values: Sequence[str]):
    """(name, text without NA tokens, typed value or NULL) of every field."""
    for f in schema.fields:
        c = F.trim(F.col(f.name))
        text = F.when(c.isin(list(na_values)) | c.isNull(), F.lit(None)).otherwise(F.col(f.name))
        yield f.name, text, text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)


def bad_fields(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ";",
               na_values: Sequence[str] = NA_TOKENS, reader=spark_text_reader) -> DataFrame:
    """(column, n_bad): fields per column that are neither an NA token nor of the column's type."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = reader(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]), delimiter)
    counts = [F.count_if(text.isNotNull() & value.isNull()).alias(name) for name, text, value in _fields(raw, schema, na_values)]
    return raw.agg(*counts).unpivot([], [f.name for f in schema.fields], "column", "n_bad")


def load_delimited(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ";",
                   na_values: Sequence[str] = NA_TOKENS, reader=spark_text_reader, strict: bool = True) -> DataFrame:
    """Delimited scan with header; NA tokens become NULL in every column.
    Text that is neither an NA token nor of the column's type fails the job;
    with ``strict=False`` it becomes NULL, and ``bad_fields`` counts such fields.

    ``reader(spark, path, text_schema, delimiter)`` returns the fields as
    text (pluggable, as in the reference); typing and NA handling follow."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = reader(spark, path, text_schema, delimiter)
    cols = []
    for name, text, value in _fields(raw, schema, na_values):
        if strict:
            wrong = F.raise_error(F.concat(F.lit(f"column {name}: not a value of its type: "), text))
            value = F.when(text.isNotNull() & value.isNull(), wrong.cast(schema[name].dataType)).otherwise(value)
        cols.append(value.alias(name))
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: comma-separated with a header; dates as yyyy-MM-dd."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma scan with a fixed schema; date columns parsed from ISO text."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
            .option("mode", "PERMISSIVE").csv(path))


def parse_requests(df: DataFrame, text_col: str, schema: T.StructType,
                   required: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). A request is accepted when its JSON parses
    and every required field is present with the right type."""
    parsed = df.withColumn("_req", F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"}))
    need = list(required or [f.name for f in schema.fields])
    ok = F.col("_req").isNotNull()
    for n in need:
        ok = ok & F.col(f"_req.{n}").isNotNull()
    flagged = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    accepted = flagged.where("_ok").select(*[c for c in df.columns if c != text_col], "_req.*")
    rejected = flagged.where(~F.col("_ok")).select(*df.columns)
    return accepted, rejected
