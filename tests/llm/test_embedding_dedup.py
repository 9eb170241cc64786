"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest
from motorisk.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    fine = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        a = np.asarray(np.asarray(v, np.float32), float)
        if np.linalg.norm(a) > 0:
            fine[i] = (a / np.linalg.norm(a), label)
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = dict.fromkeys(up, 0)
    ids = sorted(fine)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            (a, la), (b, lb) = fine[i], fine[j]
            if la == lb and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (links[i], root(i), root(i) == i) for i in up}


def corpus(seed, n=500, dim=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(25, dim))
    rows = []
    for i in range(n):
        kind = r.random()
        v = base[r.integers(25)] + r.normal(size=dim) * r.choice([0, 0.05, 0.2, 0.3]) if kind < 0.5 else r.normal(size=dim)
        rows.append((i * 3, [float(np.float32(x)) for x in v * r.choice([1.0, 2.0])], int(r.integers(3))))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [1.0, 2.0], [1.0, 2.0], [-0.0] + [1.0] * (dim - 1),
           [0.0] + [1.0] * (dim - 1)]
    return rows + [(-20 + k, v, 0) for k, v in enumerate(odd)] + [(-30, [1.0] * dim, None), (-31, [1.0] * dim, None)]


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df, **kw).collect()}


def test_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ed, "LIST_ROWS", 60)
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed, "BATCH", 16)
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_many_copies_of_one_vector(spark):
    rows = corpus(2, 60, 16) + [(1000 + i, [1.0] + [0.5] * 15, 1) for i in range(300)]
    assert result(spark, rows) == brute(rows)


def test_recall_on_the_table(spark):
    """All rows of the small table as queries: recall against brute force is 0.9 or more, no link below the threshold."""
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in t.select("vec_id", "embedding", "label").collect()]
    want, got = brute(rows), {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(t).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())


@pytest.mark.parametrize("seed", range(3))
def test_probes_and_lookup_distances(seed):
    """Neighbours at the threshold are probed (recall 0.99) and never dropped by the lookup distances."""
    r = np.random.default_rng(seed)
    unit = r.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q = ed.Quantiser(unit[:2000], 60)
    noise = r.normal(size=unit.shape)
    noise -= (noise * unit).sum(1)[:, None] * unit
    other = 0.931 * unit + math.sqrt(1 - 0.931 ** 2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    own, _, _ = q.code(unit)
    target, codes, err = q.code(other)
    mask = q.probes(unit, own, math.sqrt(2 - 2 * 0.93))
    assert mask[np.arange(len(unit)), target].mean() >= 0.99
    assert mask.mean() < 0.6
    for i in range(0, 200):
        d = q.distances(unit[i:i + 1], target[i], codes[i:i + 1])[0, 0]
        assert d - err[i] <= np.linalg.norm(unit[i] - other[i]) + 1e-9


def test_empty_table_and_extra_columns(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (2, [1.0, 0.01], 1, 6), (None, [1.0, 0.0], 1, 7)], SCHEMA + ", gid long")
    got = {r.vec_id: tuple(r)[1:] for r in ed.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, None)}


@pytest.mark.parametrize("dim,used", [(64, 64), (768, 48), (768, 24), (1536, 32)])
def test_recall_of_probes_in_few_directions(dim, used):
    """Neighbours that vary in ``used`` of ``dim`` dimensions are probed across lists."""
    r = np.random.default_rng(dim + used)
    basis = np.linalg.qr(r.normal(size=(dim, used)))[0].T
    unit = r.normal(size=(3000, used))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    noise = r.normal(size=unit.shape)
    noise -= (noise * unit).sum(1)[:, None] * unit
    other = 0.935 * unit + math.sqrt(1 - 0.935 ** 2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    unit, other = unit @ basis, other @ basis
    q = ed.Quantiser(unit[:1500], 60)
    own, target = q.code(unit)[0], q.code(other)[0]
    radius = math.sqrt(2 - 2 * 0.93)
    n = np.arange(len(unit))
    low, high = q.probes(unit, own, radius)[n, target], q.probes(other, target, radius)[n, own]
    assert (own != target).any() and np.where(own <= target, low, high).mean() >= 0.99


def test_very_large_and_very_small_components(spark):
    """Lengths whose squares leave the range of a double link by their directions."""
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [0.0, -1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_scaling_changes_no_digit():
    v = np.random.default_rng(4).normal(size=(200, 48))
    assert (ed._units([x.tobytes() for x in v]) == v / np.linalg.norm(v, axis=1)[:, None]).all()


def test_without_sigmas_no_link_is_missed(spark, monkeypatch):
    """Vectors that vary in one direction more in a part of the table than the spread tells."""
    monkeypatch.setattr(ed, "LIST_ROWS", 40)
    r = np.random.default_rng(8)
    unit = r.normal(size=(3000, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q = ed.Quantiser(unit[:1500], 60)
    own = q.code(unit)[0]
    pairs = np.argwhere(unit @ unit.T >= 0.5)                # a low threshold, so that lists are crossed
    mask = q.probes(unit, own, math.sqrt(2 - 2 * 0.5), None)
    assert mask[pairs[:, 0], own[pairs[:, 1]]].all()
    assert not q.probes(unit, own, math.sqrt(2 - 2 * 0.5), 0.5)[pairs[:, 0], own[pairs[:, 1]]].all()
    rows = corpus(9, 300)
    assert result(spark, rows, sigmas=None) == brute(rows)
