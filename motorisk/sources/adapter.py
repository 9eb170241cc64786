"""Policy-year and claim frames derived from the star-schema test tables.

The engine works on two sources: a policy-year table (one row per annual
contract) and a claim-type table (one row per claim type of a policy-year).
The driver's test data is a retail star schema, so this module derives both
sources from it with plain column expressions. Every expression has a twin
in ``POLICIES_SQL`` / ``CLAIMS_SQL`` so that DuckDB can rebuild exactly the
same rows for the oracle checks.

Mapping (k = o_orderkey, c = o_custkey, nk = c_nationkey, d = o_orderdate):
policy key k, client ``ID`` c; claims are lineitem rows with return flag
``R``; claim cost is kept in exact integer units of 1/10,000 (price in cents
times percent kept) and only shown as money by dividing at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Fixed values of the adapter (shared with the SQL twin below).
BAD_DATE_EVERY = 97          # every 97th policy carries an unparseable renewal date
BAD_DATE_TEXT = "not_a_date"
CLAIM_FLAG = "R"             # lineitem rows with this return flag are claims
NULL_CLAIM_ID_EVERY = 101    # claim rows of every 101st order lose their client id
NULL_CLAIM_COST_LINE = 7     # claim lines numbered 7 have no cost by type
UNITS_PER_MONEY = 10000      # cents x percent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fmt(months: Column) -> Column:
    """Text date dd/MM/yyyy of the order date shifted by ``months``."""
    return F.date_format(F.add_months(F.col("o_orderdate"), months.cast("int")), "dd/MM/yyyy")


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    units = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (
        F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint")
    )
    return li.where(F.col("l_returnflag") == CLAIM_FLAG).select(
        "l_orderkey", "l_linenumber", "l_linestatus", units.alias("units")
    )


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim count and cost units per policy (partial aggregation map-side)."""
    return claim_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.sum("units").alias("cost_units"), F.count(F.lit(1)).alias("n_claims")
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy-year frame with the 30 raw columns plus ``policy_key``."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    oc = order_claims(spark, sf_dir)
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(oc, o.o_orderkey == oc.l_orderkey, "left")
    k, cu, nk = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    n_claims = F.coalesce(F.col("n_claims"), F.lit(0))
    n_hist = n_claims + cu % 4
    seniority = F.lit(1) + cu % 15
    i = lambda e: e.cast("int")
    return j.select(
        k.alias("policy_key"),
        cu.alias("ID"),
        _fmt(F.lit(-12) * (k % 4)).alias("Date_start_contract"),
        F.when(k % BAD_DATE_EVERY == 0, F.lit(BAD_DATE_TEXT))
        .otherwise(_fmt(F.lit(0))).alias("Date_last_renewal"),
        _fmt(F.lit(12)).alias("Date_next_renewal"),
        _fmt(F.lit(-12) * (F.lit(18) + cu % 50)).alias("Date_birth"),
        _fmt(F.lit(12) * (cu % 7 - cu % 50)).alias("Date_driving_licence"),
        F.when(F.col("o_orderstatus") == "F", _fmt(F.lit(6))).alias("Date_lapse"),
        i(cu % 2).alias("Distribution_channel"),
        i(seniority).alias("Seniority"),
        i(F.lit(1) + k % 3).alias("Policies_in_force"),
        i(F.lit(1) + k % 3 + cu % 2).alias("Max_policies"),
        i(F.lit(1) + cu % 3).alias("Max_products"),
        i(k % 3).alias("Lapse"),
        i(k % 2).alias("Payment"),
        (F.col("o_totalprice") / 100).alias("Premium"),
        (F.coalesce(F.col("cost_units"), F.lit(0)).cast("double") / UNITS_PER_MONEY).alias("Cost_claims_year"),
        i(n_claims).alias("N_claims_year"),
        i(n_hist).alias("N_claims_history"),
        (n_hist.cast("double") / seniority.cast("double")).alias("R_Claims_history"),
        i(F.lit(1) + nk % 5).alias("Type_risk"),
        i(nk % 2).alias("Area"),
        i(k % 3).alias("Second_driver"),
        i(F.year("o_orderdate") - k % 20).alias("Year_matriculation"),
        i(F.lit(40) + k % 160).alias("Power"),
        i(F.lit(800) + (k * 7) % 2200).alias("Cylinder_capacity"),
        F.col("o_totalprice").alias("Value_vehicle"),
        i(F.lit(2) + k % 4).alias("N_doors"),
        F.col("o_orderstatus").alias("Type_fuel"),
        F.when(k % 17 != 0, F.lit(3.0) + (k % 25).cast("double") / 10).alias("Length"),
        F.when(k % 11 != 0, (F.lit(700) + (k * 13) % 1900).cast("double")).alias("Weight"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-type frame: ``ID``, ``Cost_claims_year`` (policy-year total),
    ``Cost_claims_by_type``, ``claim_type`` plus the line keys."""
    cl = claim_lines(spark, sf_dir)
    oc = order_claims(spark, sf_dir).withColumnRenamed("l_orderkey", "oc_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = cl.join(oc, cl.l_orderkey == oc.oc_orderkey).join(o, cl.l_orderkey == o.o_orderkey)
    return j.select(
        F.when(F.col("l_orderkey") % NULL_CLAIM_ID_EVERY != 0, F.col("o_custkey")).alias("ID"),
        (F.col("cost_units").cast("double") / UNITS_PER_MONEY).alias("Cost_claims_year"),
        F.when(F.col("l_linenumber") != NULL_CLAIM_COST_LINE,
               F.col("units").cast("double") / UNITS_PER_MONEY).alias("Cost_claims_by_type"),
        F.col("l_linestatus").alias("claim_type"),
        F.col("l_orderkey").alias("policy_key"),
        F.col("l_linenumber").alias("claim_line"),
    )


# ---------------------------------------------------------------------------
# SQL twin (DuckDB dialect) used by the oracle checks.
# ---------------------------------------------------------------------------

def _sql_fmt(months: str) -> str:
    return f"strftime(CAST(o.o_orderdate AS DATE) + to_months(CAST({months} AS INTEGER)), '%d/%m/%Y')"


CLAIM_LINES_SQL = f"""
claim_lines AS (
  SELECT l_orderkey, l_linenumber, l_linestatus,
         CAST(round(l_extendedprice * 100) AS BIGINT)
           * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS units
  FROM lineitem WHERE l_returnflag = '{CLAIM_FLAG}'),
order_claims AS (
  SELECT l_orderkey, sum(units) AS cost_units, count(*) AS n_claims
  FROM claim_lines GROUP BY l_orderkey)"""

POLICIES_SQL = f"""
policies AS (
  SELECT o.o_orderkey AS policy_key,
         o.o_custkey AS ID,
         {_sql_fmt('-12 * (o.o_orderkey % 4)')} AS Date_start_contract,
         CASE WHEN o.o_orderkey % {BAD_DATE_EVERY} = 0 THEN '{BAD_DATE_TEXT}' ELSE {_sql_fmt('0')} END AS Date_last_renewal,
         {_sql_fmt('12')} AS Date_next_renewal,
         {_sql_fmt('-12 * (18 + o.o_custkey % 50)')} AS Date_birth,
         {_sql_fmt('12 * (o.o_custkey % 7 - o.o_custkey % 50)')} AS Date_driving_licence,
         CASE WHEN o.o_orderstatus = 'F' THEN {_sql_fmt('6')} END AS Date_lapse,
         CAST(o.o_custkey % 2 AS INTEGER) AS Distribution_channel,
         CAST(1 + o.o_custkey % 15 AS INTEGER) AS Seniority,
         CAST(1 + o.o_orderkey % 3 AS INTEGER) AS Policies_in_force,
         CAST(1 + o.o_orderkey % 3 + o.o_custkey % 2 AS INTEGER) AS Max_policies,
         CAST(1 + o.o_custkey % 3 AS INTEGER) AS Max_products,
         CAST(o.o_orderkey % 3 AS INTEGER) AS Lapse,
         CAST(o.o_orderkey % 2 AS INTEGER) AS Payment,
         o.o_totalprice / 100 AS Premium,
         CAST(coalesce(oc.cost_units, 0) AS DOUBLE) / {UNITS_PER_MONEY} AS Cost_claims_year,
         CAST(coalesce(oc.n_claims, 0) AS INTEGER) AS N_claims_year,
         CAST(coalesce(oc.n_claims, 0) + o.o_custkey % 4 AS INTEGER) AS N_claims_history,
         CAST(coalesce(oc.n_claims, 0) + o.o_custkey % 4 AS DOUBLE) / CAST(1 + o.o_custkey % 15 AS DOUBLE) AS R_Claims_history,
         CAST(1 + c.c_nationkey % 5 AS INTEGER) AS Type_risk,
         CAST(c.c_nationkey % 2 AS INTEGER) AS Area,
         CAST(o.o_orderkey % 3 AS INTEGER) AS Second_driver,
         CAST(year(o.o_orderdate) - o.o_orderkey % 20 AS INTEGER) AS Year_matriculation,
         CAST(40 + o.o_orderkey % 160 AS INTEGER) AS Power,
         CAST(800 + (o.o_orderkey * 7) % 2200 AS INTEGER) AS Cylinder_capacity,
         o.o_totalprice AS Value_vehicle,
         CAST(2 + o.o_orderkey % 4 AS INTEGER) AS N_doors,
         o.o_orderstatus AS Type_fuel,
         CASE WHEN o.o_orderkey % 17 <> 0 THEN 3.0 + CAST(o.o_orderkey % 25 AS DOUBLE) / 10 END AS Length,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN CAST(700 + (o.o_orderkey * 13) % 1900 AS DOUBLE) END AS Weight
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN order_claims oc ON o.o_orderkey = oc.l_orderkey)"""

CLAIMS_SQL = f"""
claims AS (
  SELECT CASE WHEN cl.l_orderkey % {NULL_CLAIM_ID_EVERY} <> 0 THEN o.o_custkey END AS ID,
         CAST(oc.cost_units AS DOUBLE) / {UNITS_PER_MONEY} AS Cost_claims_year,
         CASE WHEN cl.l_linenumber <> {NULL_CLAIM_COST_LINE} THEN CAST(cl.units AS DOUBLE) / {UNITS_PER_MONEY} END AS Cost_claims_by_type,
         cl.l_linestatus AS claim_type,
         cl.l_orderkey AS policy_key,
         cl.l_linenumber AS claim_line
  FROM claim_lines cl
  JOIN order_claims oc ON cl.l_orderkey = oc.l_orderkey
  JOIN orders o ON cl.l_orderkey = o.o_orderkey)"""


def with_sources(body: str, *extra_ctes: str) -> str:
    """Prefix ``body`` with the adapter CTEs (and any extra CTE text)."""
    ctes = [CLAIM_LINES_SQL, POLICIES_SQL, CLAIMS_SQL, *extra_ctes]
    return "WITH " + ",".join(ctes) + "\n" + body
