"""Line dedup against all pairs."""

import random

import pytest
from motorisk.llm.line_dedup import dedup_lines


def line_set(line):
    w = [x for x in line.lower().split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=80):
    """rows: (id, text), ids distinct -> {id: (text, removed)}"""
    seen, out = [], {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = (None, 0)
            continue
        kept = []
        for line in t.split("\n"):
            s = line_set(line)
            dup = bool(s) and any(100 * len(s & e) >= percent * len(s | e) for e in seen)
            if s:
                seen.append(s)
            if not dup:
                kept.append(line)
        out[i] = ("\n".join(kept), len(t.split("\n")) - len(kept))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    base = [text(r.choice((5, 6, 12, 40, 90, 120))) for _ in range(14)]
    passage = text(30)
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(1, 6)):
            kind = r.random()
            w = list(r.choice(base)) if kind < 0.6 else passage + text(r.randrange(1, 30)) if kind < 0.75 else text(r.randrange(0, 30))
            if kind < 0.45:
                for _ in range(r.randrange(0, 3)):
                    w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(" ".join(x.upper() if r.random() < 0.05 else x for x in w))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed, 120) + [(500, None), (501, ""), (502, "\n\n"), (503, "a b\na b"), (504, "x  y z v w\nX y z v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.gone) for r in dedup_lines(df, removed="gone").collect()}
    assert got == brute(rows)


def test_repeated_rows_missing_ids_and_clashing_names(spark):
    line = "one two three four five six"
    rows = [(1, line, "a", 5), (1, line, "a", 5), (2, "keep me\n" + line, "b", 6), (None, line, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_doc string, line_gone int")
    got = [tuple(r) for r in dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(rows[:2] + [(2, "keep me", "b", 6), rows[3]], key=str)
    with pytest.raises(ValueError):
        dedup_lines(df, removed="LINE_GONE")


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(corpus(3, 10), "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_short_tabbed_and_unspaced_lines(spark):
    tabbed, unspaced = "a\tb\tc\td\te\tf", "これは空白のない長い一行です。" * 5
    rows = [(1, f"All rights reserved.\n{tabbed}\n{unspaced}\n\n \t"), (2, f"all  rights\tRESERVED.\nall rights\n{tabbed}\r\n\n \t"),
            (3, f"{unspaced}\nreserved. all rights\na b c d e f"), (4, "all rights reserved. by us")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.gone) for r in dedup_lines(df, removed="gone", short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("all rights\n\n \t", 2), 3: ("reserved. all rights", 2), 4: (rows[3][1], 0)}


def test_registered_query_and_stage_drop_copies_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from motorisk.llm.queries import QUERIES
    rows = [(1, "All rights reserved.\none"), (2, "All rights reserved.\ntwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (QUERIES["op3_line_dedup"](spark, str(tmp_path)), corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "two"}


def test_similar_lines_share_their_keys(spark):
    """The elimination rests on it: of a line similar to another, at most ``spare`` keys are shared with no other."""
    from motorisk.llm.line_dedup import EARLY, WHOLE, with_prefix
    lines = sorted({line for _, t in corpus(5, 60) for line in t.split("\n")})
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    for k in (9, 29, 31, 60, 150):                   # repeated runs, and lines of one first word in every fifth place
        w = [r.choice(vocab) for _ in range(k)]
        lines += [" ".join(w), " ".join(w + w[:k // 2]), " ".join(w[:-1] + ["x"]), " ".join(w * 3), " ".join(w * 2)]
        same = [x if i % 5 else "the" for i, x in enumerate(w)]
        lines += [" ".join(same), " ".join(same[1:])]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {x.i: (set(x["keys"]), x.spare) for x in with_prefix(df, "line", 80).collect()}
    sets = {i: line_set(lines[i]) for i in got}
    assert set(got) == {i for i, line in enumerate(lines) if line_set(line)}
    pairs = 0
    for i in got:
        for j in got:
            if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                pairs += 1
                assert len(got[i][0] - got[j][0]) <= got[i][1]
    assert pairs > 100
    # most lines of random words hash few more shingles than their prefix
    long = [i for i in got if len(sets[i]) > WHOLE]
    assert sum(all(k < 0 for k in got[i][0]) for i in long) > len(long) / 2 and EARLY < 0.5


def test_written_stages_leave_no_shuffle_files(spark):
    """What a stage's run shuffled is gone when it ends; the session's setting stays as it was."""
    import os
    from motorisk.llm.common import SHUFFLE_CLEANUP, Stages

    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        tops = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
        return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    setting = spark.conf.get(SHUFFLE_CLEANUP)
    sums = spark.range(20000).selectExpr("id % 7777 as k", "id").groupBy("k").sum("id")
    before = shuffled()
    st = Stages(spark)
    st.write(sums, "sums")
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    sums.collect()
    assert shuffled() - before
    st.close()
