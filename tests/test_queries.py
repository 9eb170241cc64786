"""Every registered query against its DuckDB twin on the small tables, and
plan properties (no Python evaluation in any registered plan)."""

import hashlib
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from motorisk.catalog import ORACLE, QUERIES, load_all
from motorisk.sources.adapter import TABLES

from conftest import SF_SMALL

load_all()
# Up to 100 boosting rounds each; their results are plain metric and histogram frames like those of the other queries.
SLOW_ROWS_ONLY = {"poisson_gbm", "gbt_squared", "model_comparison", "prediction_histograms", "model_comparison_flag", "prediction_histograms_flag"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if v.is_integer() and abs(v) < 2 ** 53:
            return str(int(v))
        return f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"))
    return cols, hashlib.md5("\n".join(rows).encode()).hexdigest(), len(rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_sql_entry_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(ORACLE[name]).df()
    assert _digest(sp) == _digest(dd)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "Proportion" in df.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW_ROWS_ONLY))
def test_no_python_in_plan(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _single_partition_parents(plan_text):
    """Operators directly above each SinglePartition exchange."""
    import re
    lines = plan_text.split("\n")
    parents = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        j = i - 1
        while j >= 0 and (len(lines[j]) - len(lines[j].lstrip(" :+-"))) >= depth:
            j -= 1
        parents.append(re.sub(r"^\*\(\d+\) ", "", lines[j].strip(" :+-")) if j >= 0 else "?")
    return parents


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW_ROWS_ONLY))
def test_single_partition_only_for_final_aggregates(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for parent in _single_partition_parents(plan):
        assert parent.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate")), parent
