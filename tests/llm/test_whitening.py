"""Whitening against numpy's eigenvectors and exact integers."""

import math
import random

import numpy as np
import pytest
from motorisk.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=wh.COMPONENTS):
    """vec_id -> (deviation, whitened up to sign), and explained shares."""
    rows = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    d = max((len(e) for _, e in rows), default=0)
    x = [[math.floor(1024 * float(c)) + 100000 for c in e] + [100000] * (d - len(e)) for _, e in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], dtype=object)
    z = y.astype(float) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in rows], (y * y).sum(axis=1).tolist(), z @ u / np.sqrt(e), e / np.trace(v)


def vectors(seed, n, d):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(r.standard_normal((n, d)) * np.linspace(0.02, 0.6, d))]


def check(df, rows):
    ids, deviation, white, explained = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    m = len(explained)
    mine = np.array([[got[i][c].whitened for c in range(1, m + 1)] for i in ids])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-7
    for i, dev in zip(ids, deviation):
        assert sorted(got[i]) == list(range(1, m + 1))
        assert all(r.n == len(ids) and r.deviation == dev and r.identity_error < 1e-8 for r in got[i].values())
        assert np.allclose([got[i][c].explained for c in range(1, m + 1)], explained, rtol=1e-9)


@pytest.mark.parametrize(("seed", "d"), [(1, 24), (2, 9), (3, 3)])
def test_against_numpy(spark, seed, d):
    rows = vectors(seed, 300, d)
    rows += [(1000, None), (1001, [None] + [0.1] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [0.0] * (d - 1)), (1004, [0.1] * (d - 2)), (1005, [])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).repartition(5)
    check(wh.whiten(df), rows)
    check(wh.whiten(df.selectExpr("*", "1 as v", "2 as Component", "3 as n", "4 as part")), rows)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(wh.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()])


def test_few_directions_and_repeated_rows(spark):
    r = random.Random(5)
    rows = [(i, [a, 2 * a, b, 0.5]) for i in range(40) for a, b in [(r.random(), r.random())]] + [(50, [0.25, 0.5, 0.75, 0.5])] * 4
    out = wh.whiten(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)).collect()
    # the second entry follows the first up to rounding to integers, the fourth is constant
    assert {x.component for x in out} == {1, 2, 3} and len(out) == 3 * 44
    assert all(x.identity_error < 1e-8 for x in out) and sum({x.component: x.explained for x in out}.values()) == pytest.approx(1)


def test_nothing_to_whiten(spark):
    make = lambda rows: wh.whiten(spark.createDataFrame(rows, SCHEMA)).count()
    assert [make(x) for x in ([], [(1, None, 0)], [(1, [0.5, 0.5], 0)], [(1, [], 0), (2, [], 0)], [(i, [0.5, 0.5], 0) for i in range(5)])] == [0] * 5


def test_large_entries(spark):
    rows = [(i, [1e9 * (-1) ** i, 0.5 * i, 1e300 if i == 7 else 0.0], 0) for i in range(9)]
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id for r in out} == set(range(9)) - {7}
    x = [[math.floor(1024 * c) + 100000 for c in e] for i, e, _ in rows if i != 7]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((8 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip([0, 1, 2, 3, 4, 5, 6, 8], x)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_eigenvalues(seed):
    r = np.random.default_rng(seed)
    a = r.standard_normal((20, 20)) * (r.random((20, 20)) < 0.3)
    v = a + a.T
    e = np.linalg.eigvalsh(v)
    for shift in [*(e[:-1] + np.diff(e) / 2), 0.0, e[0] - 1, e[-1] + 1]:
        assert wh.count_above(v, shift) == int((e > shift).sum()) or np.abs(e - shift).min() < 1e-12


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 1], [10, 9, 8, 8 - 1e-9, 8 - 2e-9, 7, 6, 6, 5, 5, 5, 5, 4, 3, 2], [1000, 1, 1e-3, 1e-6, 0, 0], list(range(1, 40))])
def test_spectra(spark, values):
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.standard_normal((len(values), len(values))))
    v = q * np.array(values, float) @ q.T
    v = (v + v.T) / 2
    found, u = wh.components(spark, v)
    want = [x for x in sorted(map(float, values), reverse=True)[:8] if x > 0]
    assert np.allclose(found, want, rtol=1e-7, atol=1e-10) and np.abs(u.T @ u - np.eye(len(want))).max() < 1e-10
    assert np.abs(v @ u - u * found).max() < 1e-9 * max(values)
