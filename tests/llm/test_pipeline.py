"""The whole pipeline against plain Python, and every stage on odd tables."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import test_mixing
import test_ngram_join
from motorisk.llm import quality as ql
from pyspark.sql import functions as F
from test_quality import encoded
from tokenizers import Tokenizer as Library

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int"


def corpus(seed=3):
    """Documents of two kinds of layout, with copies, near copies, shared lines and odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(250)]
    shared = [" ".join(r.choice(vocab) for _ in range(n)) for n in (2, 4, 7, 15, 30)]
    rows, good = [], []
    for i in range(70):
        junk = i % 7 == 0
        words = [r.choice(vocab).upper() + "!!" if junk else r.choice(vocab) for _ in range(r.randrange(20, 120))]
        lines = [" ".join(words[a:a + 12]) for a in range(0, len(words), 12)]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        text = "\n".join(lines)
        if i > 10 and r.random() < 0.3:
            text = r.choice(rows[5:])[1] or ""
            if r.random() < 0.5 and len(text) > 300:
                text = text.replace(text.split()[40], "changed", 1)
            if r.random() < 0.4:                            # other line ends: no line matches, the documents do
                w = text.split()
                text = "\n".join(" ".join(w[a:a + 17]) for a in range(0, len(w), 17))
        rows.append((i * 5, text, "en", r.choice(("web", "web", "web", "books", None)), len(text)))
        if not junk:
            good.append((i * 5, 1))
    long_text = "\n".join(" ".join(r.choice(vocab) for _ in range(9)) for _ in range(400))
    rows += [(1, None, None, "web", None), (2, "", "en", "books", 0), (3, " \n\t", "en", "web", 3), (None, "no id here at all", "en", "web", 17),
             (4, long_text, "en", "books", len(long_text)), (6, "one", "en", "web", 3), rows[20]]
    return rows, good


def kept_by_quality(spark, rows, good):
    """Rows the draw keeps: weights from counts of all texts and of the good ones."""
    good = {i for i, _ in good}
    per = [ql.features(*encoded([r[1] or ""]))[0] for r in rows]
    raw, target = (np.zeros(ql.BUCKETS) for _ in range(2))
    for row, f in zip(rows, per):
        np.add.at(raw, f, 1)
        if row[0] in good:
            np.add.at(target, f, 1)
    ratio = np.zeros(ql.BUCKETS)
    for a, b in ((0, ql.WORD_BUCKETS), (ql.WORD_BUCKETS, 2 * ql.WORD_BUCKETS), (2 * ql.WORD_BUCKETS, ql.BUCKETS)):
        q = raw[a:b] / raw[a:b].sum()
        extra = ql.SMOOTH * (b - a)
        seen = q > 0
        ratio[a:b][seen] = np.log((target[a:b][seen] + extra * q[seen]) / (target[a:b].sum() + extra) / q[seen])
    weight = [int(np.rint(ratio * ql.UNIT).astype(np.int64)[f].sum()) for f in per]
    noise = (spark.createDataFrame([(n, r[0], w) for n, (r, w) in enumerate(zip(rows, weight))], "n int, doc_id long, w long")
             .select("n", ql.gumbel_key(F.col("w"), F.col("doc_id")).alias("g")).collect())
    key = {r.n: r.g for r in noise}
    k = sum(w > -ql.MARGIN * ql.UNIT for w in weight)
    least = sorted(key.values(), reverse=True)[k - 1]
    return [r for n, r in enumerate(rows) if key[n] >= least]


def without_lines(rows):
    """Lines that match no earlier line; rows with one id are one document."""
    seen, text = [], {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        kept = []
        for line in t.split("\n"):
            s = test_ngram_join.shingles(line)
            if not any(s and 100 * len(s & e) >= 80 * len(s | e) for e in seen):
                kept.append(line)
            seen.append(s)
        text[i] = "\n".join(kept)
    new = [(r[0], text.get(r[0], r[1]) if r[1] is not None else None, *r[2:4]) for r in rows]
    return [(*r, None if r[1] is None else len(r[1])) for r in new]


def without_copies(rows):
    group = test_ngram_join.brute([(r[0], r[1]) for r in {(r[0], r[1]) for r in rows} if r[0] is not None])
    return [r for r in rows if r[0] is None or group[r[0]][1] == r[0]]


def test_run_matches_plain_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ql, "SMOOTH", 0.01)                 # few labels decide
    rows, good = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(good, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    want = kept_by_quality(spark, rows, good)
    assert 0 < len(want) < len(rows)
    lines = without_lines(want)
    assert any(a[1] != b[1] for a, b in zip(want, lines))
    docs = without_copies(lines)
    assert 0 < len(docs) < len(lines)
    times = Counter()
    for (i, _), n in test_mixing.brute([(r[0], r[3], r[1]) for r in docs]).items():
        times[i] += n
    assert max(times.values()) > 1
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {r[0]: r for r in docs}
    out = Counter()
    for i, n in times.items():
        ids = library.encode(by_id[i][1] or "", add_special_tokens=False).ids
        out[i, by_id[i][3], len(ids), tuple(ids)] += n
    assert Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in got) == out


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Nulls, empty and repeated rows, ties and clashing names; an empty table stays empty, columns stay."""
    extra = ", weight long, gid string, line string, r int, component_id string, key long, epoch int, line_doc long, id string"
    more = (7, "g", None, 1, "c", 2, 3, 4, "i")
    rows = [(1, "Same text in two rows of the table", "en", "web", 34), (1, "Same text in two rows of the table", "en", "web", 34), (2, None, None, None, None),
            (3, "", "en", "web", 0), (None, "no id", "en", "web", 5), (4, "x " * 30000, "en", "web", 60000)]
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(*r, *more) for r in rows], SCHEMA + extra)
    got = stage(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in got.collect()]
    assert {1, 2, 3, 4, None} == set(ids) and ids.count(1) >= 2
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
