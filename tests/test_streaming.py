"""Rows-only queries proved against their batch or SQL counterparts."""

import duckdb
import pytest

from motorisk.catalog import QUERIES as Q, load_all
from motorisk.checks import models as CM
from motorisk.sources.adapter import TABLES

from conftest import SF_SMALL

load_all()


def test_drift_stream_equals_batch(spark):
    stream = {(r["segment"], r["window_start"]): r["psi"] for r in Q["drift_stream"](spark, SF_SMALL).collect()}
    batch = {(r["segment"], r["window_start"]): r["psi"] for r in Q["drift_psi"](spark, SF_SMALL).collect()}
    assert stream and set(stream) == set(batch)
    for k, v in stream.items():
        assert v == pytest.approx(batch[k], abs=1e-6)


def test_gamma_saturated_close_to_level_means(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sql = CM.C.A.with_sources(CM.GAMMA_SAT_SQL, *CM.C.SPLIT_CTES)
    expected = {int(r[0]): r[1] for r in con.execute(sql).fetchall()}
    got = {r[0]: r[1] for r in CM.gamma_level_means(spark, SF_SMALL).collect()}
    assert set(got) == set(expected)
    for k in got:
        assert got[k] == pytest.approx(expected[k], rel=1e-6)
