"""Quality classifier: features and weights against plain Python, the draw, held-out separation."""

import math
import random
import re

import numpy as np
import pytest
from motorisk.llm import quality as ql
from motorisk.llm import textbytes as tb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = ["The the THE cat", "", "  ", "one", "A!! B!! CC!!", "word*** other&&& x", "é É ñ ñ 12 3.5", "a\nb\tc\x0bd", "end. next, (so) it's -", "🙂 日本 x"]


def encoded(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_words_and_ngrams_by_bytes():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("aB c\n\té") for _ in range(r.randrange(0, 40))) for _ in range(200)]
    data, offs = encoded(texts)
    h, row, first = tb.words(data, offs)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    lower = [[bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws] for ws in split]
    assert np.diff(first).tolist() == [len(w) for w in split] and row.tolist() == [i for i, w in enumerate(split) for _ in w]
    flat = [w for ws in lower for w in ws]
    assert len({(w, x) for w, x in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    for k in (1, 2, 5):
        g, gf = tb.ngrams(h, first, k)
        want = [[tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] for w in lower]
        assert np.diff(gf).tolist() == [len(x) for x in want]
        flat = [x for xs in want for x in xs]
        assert len(set(zip(flat, g.tolist()))) == len(set(flat)) == len(set(g.tolist()))
        sets = tb.distinct_per_row(g, gf)
        assert [len(s) for s in sets] == [len(set(x)) for x in want]


def test_features_do_not_depend_on_neighbours():
    data, offs = encoded(TEXTS)
    bucket, row = ql.features(data, offs)
    for i, t in enumerate(TEXTS):
        alone, _ = ql.features(*encoded([t]))
        assert sorted(bucket[row == i].tolist()) == sorted(alone.tolist())
        n = len(t.split())
        assert len(alone) == (0 if not n else 5 * n - 4 if n > 1 else 2)


def test_weights_and_draw_match_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = np.zeros(ql.BUCKETS), np.zeros(ql.BUCKETS)
    per = {}
    for i, t in rows.items():
        per[i], _ = ql.features(*encoded([t]))
        np.add.at(raw, per[i], 1)
        if i in good:
            np.add.at(target, per[i], 1)
    ratio = np.zeros(ql.BUCKETS)
    for a, b in ((0, ql.WORD_BUCKETS), (ql.WORD_BUCKETS, 2 * ql.WORD_BUCKETS), (2 * ql.WORD_BUCKETS, ql.BUCKETS)):
        for j in range(a, b):
            if raw[j]:
                q = raw[j] / raw[a:b].sum()
                ratio[j] = math.log((target[j] + ql.SMOOTH * (b - a) * q) / (target[a:b].sum() + ql.SMOOTH * (b - a)) / q)
    model = ql.fit(docs, labels)
    assert np.abs(model - np.rint(ratio * ql.UNIT)).max() <= 1
    got = {r.doc_id: r for r in ql.decisions(docs, labels, k=700).collect()}
    for i in rows:
        assert got[i].log_weight == model[per[i]].sum() / ql.UNIT
    best = sorted(got.values(), key=lambda r: -r.gumbel_key)[:700]
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in best}
    kept = ql.keep_good(docs, labels)
    assert kept.columns == docs.columns
    mine = {r.doc_id for r in ql.decisions(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == mine


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = ql.decisions(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] >= 0.99 and share[0] <= 0.05


@pytest.mark.parametrize("k", [1, 2, 50, 199, 200])
def test_kth_largest(spark, k):
    r = random.Random(k)
    v = [r.choice([r.gauss(0, 1), 0.0, 1e-9, 1e9]) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    assert ql.kth_largest(df, "x", k, cells=4) == sorted(v, reverse=True)[k - 1]


def test_missing_values_ties_and_empty_tables(spark):
    schema = "doc_id long, text string, weight long, kept string"
    df = spark.createDataFrame([(1, None, 5, "a"), (2, "", 6, "b"), (None, "x y", 7, None), (2, "", 6, "b")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(ql.keep_good(df, none).collect(), key=str) == sorted(df.collect(), key=str)
    assert ql.keep_good(df.where("false"), none).collect() == []
    assert {r.log_weight for r in ql.decisions(df, none).collect()} == {0.0}


def test_inclusion_follows_the_weights(spark):
    """Of equally many documents of weight 1 and 4, a small draw takes about four of the heavy for one of the light."""
    n, k, heavy = 300, 60, round(math.log(4) * ql.UNIT)
    df = spark.createDataFrame([(i, heavy if i < n else 0) for i in range(2 * n)], "doc_id long, weight long").coalesce(2).cache()
    taken = []
    for seed in range(6):
        key = ql.gumbel_key(F.col("weight"), F.col("doc_id"), seed)
        ids = [r.doc_id for r in df.where(key >= F.lit(ql.cut(df, k=k, seed=seed))).collect()]
        assert len(ids) == k
        taken += ids
    assert 0.7 <= sum(i < n for i in taken) / len(taken) <= 0.87
    assert len(set(taken)) > 1.5 * k


def test_tasks_hold_little_of_a_large_batch():
    """A batch of 8 MB of text: what counting n-grams, set hashes and encoding hold beside it at most."""
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers
    from motorisk.llm import bpe, ngram_join
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(3000)]
    texts = [" ".join(r.choices(vocab, k=500)) for _ in range(2000)]
    marked = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 3 == 0 for i in range(2000)])], names=["t", "g"])
    keyed = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(2000))], names=["t", "id"])

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6
    assert peak(lambda: list(ql._counts([marked]))) < 40
    assert peak(lambda: [None for _ in ngram_join.hashed_sets([keyed], 5)]) < 60
    enc = bpe.Encoder(bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), None)
    enc.encode(texts[:200])                         # the memo of the vocabulary stays
    size = bpe.ENCODE_ROWS
    assert peak(lambda: enc.encode(texts[:size])) < 6
