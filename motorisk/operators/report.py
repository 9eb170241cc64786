"""Claims-distribution report (G5: F18 F19 A3 O1 A4 A5).

Per claim-count bin: distinct policies, total claims and the share of all
policies, plus a ``Sum`` row. The distinct count runs as Spark's two-phase
distinct aggregation (first on (bin, policy id), then per bin), so the
dominant bin (most policies have no claim) is spread over all tasks. The
total used for the shares is a scalar subquery over the at most 27 bin rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decode import CLAIM_BIN_MAX, claims_bin, claims_bin_order

TOTAL_LABEL = "Sum"
MISSING_TEXT = "nan"


def unique_policy_id(id_col: str = "ID", start: str = "Date_last_renewal",
                     end: str = "Date_next_renewal"):
    """client id followed by both renewal dates; missing parts read 'nan'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT))
    return F.concat(part(id_col), part(start), part(end))


def claims_distribution(policies: DataFrame, count_col: str = "N_claims_year") -> DataFrame:
    binned = policies.select(
        claims_bin(count_col).alias("claim_bin"),
        claims_bin_order(count_col).alias("bin_order"),
        unique_policy_id().alias("unique_policy_id"),
        F.col(count_col).alias("n"),
    ).where(F.col("claim_bin").isNotNull())
    grouped = binned.groupBy("claim_bin", "bin_order").agg(
        F.count_distinct("unique_policy_id").alias("Policies"),
        F.sum("n").cast("bigint").alias("Claims"),
    )
    total = grouped.select(F.sum("Policies")).scalar()
    shares = grouped.withColumn(
        "Proportion", F.round(F.col("Policies").cast("double") / total, 4)
    )
    summary = shares.agg(
        F.lit(TOTAL_LABEL).alias("claim_bin"),
        F.lit(CLAIM_BIN_MAX + 2).alias("bin_order"),
        F.sum("Policies").cast("bigint").alias("Policies"),
        F.sum("Claims").cast("bigint").alias("Claims"),
        F.round(F.sum("Proportion"), 4).alias("Proportion"),
    )
    return shares.unionByName(summary).orderBy("bin_order")
