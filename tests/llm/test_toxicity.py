"""Toxicity: restored words and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from motorisk.llm import toxicity as tx
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return tx.character_model(tables[0])


@pytest.mark.parametrize("seen,word", [("l0ser", "loser"), ("looooser", "loser"), ("1d10t", "idiot"), ("p@thetic", "pathetic"),
                                       ("d1sgu$ting", "disgusting"), ("tra5h", "trash"), ("m.o.r.o.n", "moron"), ("scuuuum", "scum"),
                                       ("the", "the"), ("cl0wn!!", "clown")])
def test_restores_disguised_words(model, seen, word):
    assert word in tx.words_of(seen, model)


def test_spaced_letters(model):
    r = tx.Reader(model)
    assert ["moron"] in r.read("you m o r o n there") and ["trash"] in r.read("T-R-A-S-H")
    assert r.read("") == [] and r.read("y a o") != [["yao"]]


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = tx.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 20 and sum(toxic) / len(toxic) >= 0.9
    assert sum(clean) / len(clean) <= 0.01


def test_teaching_rows_and_disguised_text(spark, tables, model):
    docs, labels = tables
    prior, weights = tx.fit(docs, labels, model)
    rows = [(1, "Anon wh m0r0n thes 1d10t"), (2, "Anon wh thes"), (3, None), (4, ""), (5, "the loooooser"), (6, "w " * 20000 + "scum trash"), (2, "Anon wh thes")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = {r.doc_id: r.score for r in tx.score(df, model, prior, weights).collect()}
    assert all(got[i] >= 0.7 for i in (1, 5, 6)) and all(got[i] < 0.5 for i in (2, 3, 4)) and got[3] == got[4] == got[2]
    flag = spark.range(50).select("id", tx.train_rows(F.col("id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 3 != 1) for r in flag)


def test_no_labels_and_empty_tables(spark, tables):
    docs, labels = tables
    small = docs.limit(5)
    assert {r.score for r in tx.toxicity(small, labels.where("false")).collect()} == {0.5}
    assert tx.toxicity(docs.where("false"), labels).collect() == []
    with pytest.raises(ValueError):
        tx.score(docs, tx.CharacterModel(np.zeros(tx.SYMBOLS ** 3)), 0.0, {}, out="LANG")


@pytest.mark.parametrize("seen,word", [("$tupid", "stupid"), ("!diot", "idiot"), ("|oser", "loser"), ("a$$", "ass"), ("@$$", "ass"),
                                       ("455", "ass"), ("($tupid!)", "stupid"), ("(lown", "clown"), ("stupid!!", "stupid"), ("<the", "the"), ("a$$hole", "asshole")])
def test_signs_at_the_ends_may_be_letters(model, seen, word):
    assert word in tx.words_of(seen, model)


def test_signs_without_letters(model):
    assert tx.words_of("--", model) == tx.words_of("***", model) == tx.words_of("...", model) == []
    assert len(tx.words_of("!|" * 5000 + "oser" + "$(" * 5000, model)) <= 80


def most_likely(model, token, kept):
    """The best of all readings of a lattice, one by one."""
    options = []
    for i, o in enumerate(token):
        moves = [(o, 0.0)] if o.isalpha() else [(c, tx.IMITATED) for c in tx.IMITATES.get(o, "")]
        if i and o == token[i - 1] and i not in kept:
            moves.append(("", tx.STUTTER))
        elif o in tx.SEPARATORS:
            moves.append(("", tx.PADDED))
        options.append(moves or [(o, tx.KEPT)])
    best = []
    for path in itertools.product(*options):
        a = b = 0
        score = sum(cost for _, cost in path)
        for c, _ in path:
            if c:
                s = tx._symbol(c)
                score += model.log[a][b][s]
                a, b = b, s
        best.append((score + model.log[a][b][0], "".join(c for c, _ in path)))
    return max(best)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_finds_the_best_of_all_readings(seed):
    r = random.Random(seed)
    random_model = tx.CharacterModel(np.random.default_rng(seed).integers(0, 50, tx.SYMBOLS ** 3))
    for _ in range(300):
        token = "".join(r.choice("abio013$!|5.-*\u00e9#aa11") for _ in range(r.randrange(0, 8)))
        kept = frozenset(i for i in range(len(token)) if r.random() < 0.1)
        assert random_model.restore(token, kept) == most_likely(random_model, token, kept)[1]
