"""Frames and SQL pieces shared by several registrations.

``freq_split``: the claim-count modelling dataset (G3) with the seeded 80/20
split (X1). ``level_scored``: the same rows with the training mean of the
target per ``Type_risk`` as prediction (M5 per level), the stand-in model of
the evaluation queries because its SQL twin is exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.baseline import MeanRegressor
from ..operators.dataset import modelling_dataset
from ..operators.materialize import materialize
from ..operators.splits import split_data
from ..sources import adapter as A

SEED = 42
TEST_RATIO = 0.2
LEVEL_COL = "Type_risk"
TARGET = "claims_frequency"


def r6(c):
    return F.round(c, 6)


def freq_dataset(spark, sf_dir):
    return modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "count")


def flag_dataset(spark, sf_dir):
    return modelling_dataset(A.policies(spark, sf_dir), A.claims(spark, sf_dir), "flag")


def freq_split(spark, sf_dir):
    return split_data(freq_dataset(spark, sf_dir), "policy_key", TEST_RATIO, True, SEED)


def stored_split(spark, sf_dir, columns):
    """``freq_split`` of these columns over a dataset that is written once, for fits that read it many times."""
    stored = materialize(freq_dataset(spark, sf_dir).select(*dict.fromkeys(["policy_key", *columns])), "dataset")
    return split_data(stored, "policy_key", TEST_RATIO, True, SEED)


def level_scored(spark, sf_dir):
    split = freq_split(spark, sf_dir)
    model = MeanRegressor(labelCol=TARGET, groupCol=LEVEL_COL).fit(split.where(F.col("split") == "train"))
    return model.transform(split)


# --- SQL twins -------------------------------------------------------------

FREQ_DS_CTE = """
freq_ds AS (
  SELECT p.*, CAST(coalesce(f.n, 0) AS BIGINT) AS claims_frequency
  FROM policies p LEFT JOIN (
    SELECT ID, Cost_claims_year, count(Cost_claims_by_type) AS n FROM claims
    WHERE ID IS NOT NULL AND Cost_claims_year IS NOT NULL GROUP BY ID, Cost_claims_year) f
  ON p.ID = f.ID AND p.Cost_claims_year = f.Cost_claims_year)"""

FREQ_SPLIT_CTE = f"""
freq_split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(CAST(policy_key AS VARCHAR) || '{SEED}'), policy_key) - 1
                      < (SELECT CAST(ceil(count(*) * CAST({TEST_RATIO} AS DOUBLE)) AS BIGINT) FROM freq_ds)
                 THEN 'test' ELSE 'train' END AS split
  FROM freq_ds)"""

LEVEL_SCORED_CTE = f"""
level_scored AS (
  SELECT s.*, CAST(coalesce(m.pred, (SELECT avg(CAST({TARGET} AS DOUBLE)) FROM freq_split WHERE split = 'train')) AS DOUBLE) AS prediction
  FROM freq_split s LEFT JOIN (
    SELECT CAST({LEVEL_COL} AS VARCHAR) AS lvl, avg(CAST({TARGET} AS DOUBLE)) AS pred
    FROM freq_split WHERE split = 'train' AND {LEVEL_COL} IS NOT NULL GROUP BY 1) m
  ON CAST(s.{LEVEL_COL} AS VARCHAR) = m.lvl)"""

SPLIT_CTES = (FREQ_DS_CTE, FREQ_SPLIT_CTE)
SCORED_CTES = (FREQ_DS_CTE, FREQ_SPLIT_CTE, LEVEL_SCORED_CTE)


def sql_quote(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"
