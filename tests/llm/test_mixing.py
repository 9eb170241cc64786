"""Mixing against sorted lists, and its SQL twin."""

import hashlib
import math

import duckdb
import pytest
from motorisk.llm import mixing as mx
from motorisk.llm import queries


def brute(rows, share=mx.ENTROPY_SHARE, passes=mx.MOST_PASSES, seed=mx.SEED, budget=None):
    """rows: (id, source, text) -> {(id, epoch): times}"""
    docs = [(i, s, len((t or "").split()), hashlib.md5(f"{'' if i is None else i}|{seed}".encode()).hexdigest()) for i, s, t in rows]
    size = {}
    for _, s, n, _ in docs:
        size[s] = size.get(s, 0) + n
    live = {s: n for s, n in size.items() if n}
    total = sum(live.values())

    def reached(e):
        p = [(n / total) ** e for n in live.values()]
        h = -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
        return h >= share * math.log(len(live)) or (max(live.values()) / min(live.values())) ** (1 - e) >= passes
    e = 1.0 if len(live) < 2 or reached(1.0) else max((k / mx.STEPS for k in range(0, mx.STEPS + 1, 1) if reached(k / mx.STEPS)), default=0.0)
    z = sum((n / total) ** e for n in live.values())
    top = max(live.values(), default=0)
    whole = budget if budget is not None else top / ((top / total) ** e / z) if total else 0
    out = {}
    for s in size:
        mine = sorted((d for d in docs if d[1] == s), key=lambda d: d[3])
        want = round((size[s] / total) ** e / z * whole) if size[s] else 0
        blocks, room = divmod(want, size[s]) if size[s] else (1, 0)
        for d in mine:
            upto = sum(x[2] for x in mine if x[3] <= d[3])
            first = min((x[3] for x in mine if sum(y[2] for y in mine if y[3] <= x[3]) > room), default=None)
            times = blocks + (1 if size[s] and first is not None and d[3] < first and upto <= room else 0)
            for k in range(1, times + 1):
                out[d[0], k] = out.get((d[0], k), 0) + 1
    return out


def table(sizes):
    rows, i = [], 0
    for s, (n, words) in sizes.items():
        for k in range(n):
            rows.append((i, s, " ".join(["w"] * (words + k % 3))))
            i += 1
    return rows


SIZES = {"a": (40, 20), "b": (12, 7), "c": (5, 9), None: (6, 4)}


def result(spark, rows, **kw):
    got = {}
    for r in mx.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4), **kw).collect():
        got[r.doc_id, r.epoch] = got.get((r.doc_id, r.epoch), 0) + 1
    return got


def test_matches_brute_force(spark):
    rows = table(SIZES) + [(900, "a", None), (901, "empty", ""), (902, "b", "  ")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {i for i, _ in got} == {r[0] for r in rows}              # nothing is lost
    assert max(k for _, k in got) == 2


def test_budget_below_one_block(spark):
    rows = table(SIZES)
    got = result(spark, rows, budget=300)
    assert got == brute(rows, budget=300)


def test_entropy_target(spark):
    rows = table(SIZES)
    got = result(spark, rows, most_passes=100.0, entropy_share=0.9)
    assert got == brute(rows, share=0.9, passes=100.0)


def test_repeated_rows_clashes_and_empty_table(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (2, "b", "z z z z z z z z")]
    assert result(spark, rows) == brute(rows)
    df = spark.createDataFrame([(1, "a", "x", 5, "q")], "doc_id long, source string, text string, mix_cut int, mix_source string")
    assert mx.mix(df).drop("epoch", "order_hash").collect() == df.collect()
    with pytest.raises(ValueError):
        mx.mix(df, epoch="MIX_CUT")
    assert mx.mix(df.where("false")).collect() == []


def test_sql_twin(spark):
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    cols = ["doc_id", "source", "n_tokens", "order_hash", "epoch"]
    want = con.execute(queries.OP2_SQL).df()[cols].astype(str)
    got = queries.QUERIES["op2_source_mixing"](spark, d).toPandas()[cols].astype(str)
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want.values))
