"""N-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from motorisk.llm import ngram_join as nj

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=5, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed=5, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows, i = [], 0
    base = [[r.choice(vocab) for _ in range(r.choice((3, 6, 20, 60, 200)))] for _ in range(40)]
    while i < n:
        w = list(r.choice(base))
        kind = r.random()
        if kind < 0.6:
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.8:
            w = passage + [r.choice(vocab) for _ in range(r.randrange(4, 60))]
        elif kind < 0.9:
            w = w[: r.randrange(0, len(w) + 1)]
        rows.append((i * 7, " ".join(x.upper() if r.random() < 0.1 else x for x in w) + r.choice(("", "\n", "\t "))))
        i += 1
    rows += [(-5, None), (-4, ""), (-3, " \n\t "), (-2, "one two"), (-1, "ONE\x0btwo")]
    return rows


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, **kw).collect()}


def test_matches_all_pairs(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_blocks_of_a_large_family_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 6)
    monkeypatch.setattr(nj, "FREQUENT_SHARE", 0.02)
    rows = corpus(9, 200)
    assert result(spark, rows) == brute(rows)


def test_other_threshold_and_length(spark):
    rows = corpus(11, 150)
    assert result(spark, rows, k=2, percent=60) == brute(rows, 2, 60)


def test_empty_table_and_extra_columns(spark):
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 8, "y"), (2, "a b c d e f", 8, "y")],
                               "doc_id long, text string, node long, component string")
    got = [tuple(r) for r in nj.jaccard_components(df).orderBy("doc_id").collect()]
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_trie_spans_all_links(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(120):
        base = np.arange(40) + 40 * r.integers(0, 4)
        keep = r.random(40) > r.choice([0.02, 0.1, 0.3])
        sets.append(np.sort(np.concatenate([base[keep], r.integers(1000, 1100, 3)])).astype(np.uint64))
    sets = [np.unique(s) for s in sets]
    up = list(range(len(sets)))

    def root(x, up):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            a = len(np.intersect1d(sets[i], sets[j]))
            if 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a):
                up[max(root(i, up), root(j, up))] = min(root(i, up), root(j, up))
    mine = list(range(len(sets)))
    for i, j in nj.trie_links(sets, 80):
        a = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a)
        x, y = sorted((root(i, mine), root(j, mine)))
        mine[y] = x
    assert [root(i, up) for i in range(len(sets))] == [root(i, mine) for i in range(len(sets))]


def test_postings_do_not_grow_with_the_buckets():
    r = np.random.default_rng(1)
    block = {int(n): np.sort(r.integers(0, 1 << 63, 60, dtype=np.uint64)) for n in r.integers(0, 1 << 60, 3000)}
    size = {b: sum(len(x) for c in ("keys", "nodes") for x in nj._packed(block, b).column(c).to_pylist()) for b in (1, 12, 4000)}
    assert set(size.values()) == {16 * 60 * len(block)}
