"""Fingerprints against sets of paragraphs computed directly."""

import hashlib
import random

from motorisk.llm import fingerprint as fp
from motorisk.llm.common import Stages
from pyspark.sql import functions as F


def brute(rows):
    """rows: (id, text), ids distinct"""
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        par = lambda s: {p for p in s.split("\n") if p}
        like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(par(t), par(edited)), 9), round(like(par(t), par(nxt)), 9))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    pool = [f"paragraph {i} " + r.choice(["é", "🙂", "x"]) * r.randrange(0, 9) for i in range(60)]
    rows = []
    for i in range(n):
        k = r.choice((0, 1, 2, 5, 12, 40, 150))
        lines = [r.choice(pool) if r.random() < 0.5 else f"own {i} {j} {r.random()}" for j in range(k)]
        rows.append((i * 5 - 100, "\n".join(lines)))
    return rows


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprints(df).collect()}


def test_matches_paragraph_sets(spark):
    rows = corpus(3, 90) + [(7001, None), (7002, ""), (7003, "\n\n\n"), (7004, "a"), (7005, "same\ntext"), (7006, "same\ntext")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert got[7005].fingerprint == got[7006].fingerprint and got[7006].near_next == 1.0
    assert got[7001].fingerprint == got[7002].fingerprint


def test_peeling_names_the_differing_digests(spark):
    a, b = list(range(100, 130)), list(range(104, 133))
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    state = df.select(fp.peel(fp.subtract(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).alias("s")).first().s
    assert {(g.d, g.n) for g in state.got} == {(x, 1) for x in range(100, 104)} | {(x, -1) for x in range(130, 133)}
    assert all((c.n, c.d, c.c) == (0, 0, 0) for c in state.cells)


def test_larger_sketches_recover_everything(spark):
    rows = [(i, list(range(i, i + n)), list(range(i + m, i + m + n))) for i, (n, m) in enumerate([(300, 300), (1000, 10), (50, 25), (0, 0), (40, 0)])]
    df = spark.createDataFrame(rows, "id int, x array<bigint>, y array<bigint>")
    got = {r.id: r.d for r in fp.recovered_differences(df, "x", "y", ["id"], Stages(spark)).collect()}
    assert got == {0: 600, 1: 20, 2: 50, 4: 0}


def test_ties_missing_ids_single_row_and_empty_table(spark):
    schema = "doc_id long, text string, own string, row int"
    df = spark.createDataFrame([(1, "a\nb", "o", 1), (1, "a\nb", "o", 1), (None, "c", "o", 2)], schema)
    got = sorted(((r.doc_id is None, r.n_chars, r.near_next) for r in fp.fingerprints(df).collect()))
    assert got == [(False, 3, 0.0), (False, 3, 1.0), (True, 1, 0.0)]
    one = fp.fingerprints(df.where("doc_id is null")).collect()
    assert [(r.near_next, r.near_edited) for r in one] == [(1.0, 1.0)]
    assert fp.fingerprints(df.where("false")).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(corpus(3, 5), "doc_id long, text string")
    plan = fp.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Scan ExistingRDD" not in plan


def test_a_change_in_a_long_line_alters_few_pieces(spark):
    r = random.Random(5)
    spaced = " ".join(f"w{r.randrange(500)}" for _ in range(2000))
    unspaced = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000))
    encoded = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(6000))
    texts = {"spaced": spaced, "unspaced": unspaced, "encoded": encoded}
    for name, t in texts.items():
        other = t[:1000] + "#" + t[1001:]
        df = spark.createDataFrame([(2, t), (1, other)], "doc_id long, text string")
        got = {x.doc_id: x for x in fp.fingerprints(df).collect()}
        assert 0.9 < got[2].near_next < 1.0 and 0.3 < got[2].near_edited, name
    far = spark.createDataFrame([(2, spaced), (1, " ".join(f"v{i}" for i in range(2000)))], "doc_id long, text string")
    assert {x.doc_id: x.near_next for x in fp.fingerprints(far).collect()} == {1: 0.0, 2: 0.0}
