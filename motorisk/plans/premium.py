"""Direct-premium dataset (G4: P2 -> F20–F25 -> F1 -> S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dates import DAY_FIRST_FORMAT, columns_with_prefix, convert_columns_to_date
from ..functions.decode import PREMIUM_LABELS, decode_columns
from ..sources.files import write_csv

# Columns a new client cannot have yet (future or history).
LEAKAGE_COLUMNS = (
    "ID", "Date_last_renewal", "Date_start_contract", "Date_next_renewal",
    "Seniority", "Policies_in_force", "Max_policies",
    "Max_products", "Lapse", "Date_lapse", "Cost_claims_year",
    "N_claims_year", "N_claims_history", "R_Claims_history",
)


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """Drop named columns; an unknown name is an error, as in pandas."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{missing} not found in axis")
    return df.drop(*columns)


def premium_dataset(policies: DataFrame, date_format: str = DAY_FIRST_FORMAT) -> DataFrame:
    df = drop_columns(policies, LEAKAGE_COLUMNS)
    df = decode_columns(df, PREMIUM_LABELS)
    return convert_columns_to_date(df, columns_with_prefix(df, "Date_"), date_format)


def export_premium_dataset(policies: DataFrame, path: str, date_format: str = DAY_FIRST_FORMAT) -> None:
    """G4 end to end: the dataset written as comma text with a header (S3)."""
    write_csv(premium_dataset(policies, date_format), path)
