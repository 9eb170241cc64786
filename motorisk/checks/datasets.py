"""G3 / G5 registrations: modelling dataset and claims-distribution report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators.dataset import modelling_dataset
from ..operators.report import claims_distribution
from ..sources import adapter as A

POLICY_COLUMNS = (
    "policy_key, ID, Date_start_contract, Date_last_renewal, Date_next_renewal, Date_birth, "
    "Date_driving_licence, Date_lapse, Distribution_channel, Seniority, Policies_in_force, "
    "Max_policies, Max_products, Lapse, Payment, Premium, Cost_claims_year, N_claims_year, "
    "N_claims_history, R_Claims_history, Type_risk, Area, Second_driver, Year_matriculation, "
    "Power, Cylinder_capacity, Value_vehicle, N_doors, Type_fuel, Length, Weight"
)

FREQUENCY_SQL = A.with_sources("""
SELECT p.*, CAST(coalesce(f.claims_frequency, 0) AS BIGINT) AS claims_frequency
FROM policies p
LEFT JOIN (
  SELECT ID, Cost_claims_year, count(Cost_claims_by_type) AS claims_frequency
  FROM claims WHERE ID IS NOT NULL AND Cost_claims_year IS NOT NULL
  GROUP BY ID, Cost_claims_year) f
ON p.ID = f.ID AND p.Cost_claims_year = f.Cost_claims_year
""")


@register("claims_frequency", FREQUENCY_SQL)
def claims_frequency(spark, sf_dir):
    return modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "count")


COST_FLAG_SQL = A.with_sources("""
SELECT p.policy_key, p.ID, p.Cost_claims_year,
       round(coalesce(f.cost, 0.0), 4) AS Cost_claims_by_type,
       CAST(coalesce(f.cost, 0.0) > 0 AS INTEGER) AS claims_frequency
FROM policies p
LEFT JOIN (
  SELECT ID, Cost_claims_year, coalesce(sum(Cost_claims_by_type), 0.0) AS cost
  FROM claims WHERE ID IS NOT NULL AND Cost_claims_year IS NOT NULL
  GROUP BY ID, Cost_claims_year) f
ON p.ID = f.ID AND p.Cost_claims_year = f.Cost_claims_year
""")


@register("claims_cost_flag", COST_FLAG_SQL)
def claims_cost_flag(spark, sf_dir):
    ds = modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "flag")
    return ds.select("policy_key", "ID", "Cost_claims_year",
                     F.round("Cost_claims_by_type", 4).alias("Cost_claims_by_type"),
                     "claims_frequency")


DISTRIBUTION_SQL = A.with_sources("""
SELECT * FROM shares
UNION ALL
SELECT 'Sum', 27, CAST(sum(Policies) AS BIGINT), CAST(sum(Claims) AS BIGINT), round(sum(Proportion), 4)
FROM shares
""", """
binned AS (
  SELECT CASE WHEN N_claims_year <= 25 THEN CAST(N_claims_year AS VARCHAR) ELSE '25+' END AS claim_bin,
         CAST(CASE WHEN N_claims_year <= 25 THEN N_claims_year ELSE 26 END AS INTEGER) AS bin_order,
         coalesce(CAST(ID AS VARCHAR), 'nan') || coalesce(Date_last_renewal, 'nan')
           || coalesce(Date_next_renewal, 'nan') AS unique_policy_id,
         N_claims_year AS n
  FROM policies WHERE N_claims_year IS NOT NULL)""", """
grouped AS (
  SELECT claim_bin, bin_order, count(DISTINCT unique_policy_id) AS Policies,
         CAST(sum(n) AS BIGINT) AS Claims
  FROM binned GROUP BY claim_bin, bin_order)""", """
shares AS (
  SELECT *, round(CAST(Policies AS DOUBLE) / (SELECT sum(Policies) FROM grouped), 4) AS Proportion
  FROM grouped)""")


@register("claims_distribution", DISTRIBUTION_SQL)
def claims_distribution_report(spark, sf_dir):
    return claims_distribution(A.policies(spark, sf_dir))
