"""Packing: exact round trip, segment bookkeeping, best fit against a plain search."""

import random

import numpy as np
import public_tokenizers
import pytest
from motorisk.llm import packing as pk

PATH, END = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256
ENC = pk.ranked_encoder(PATH, public_tokenizers.PATTERN)


def naive(lengths, most):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r, x in enumerate(room) if x >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
            rows[r].append(i)
            room[r] -= lengths[i]
        else:
            rows.append([i])
            room.append(most - lengths[i])
    return rows, room


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    r = random.Random(seed)
    most = r.choice([7, 64, 100])
    lengths = [r.randrange(1, most + 1) for _ in range(300)]
    got = pk.best_fit_decreasing(np.asarray(lengths), most)
    rows, room = naive(lengths, most)
    assert sorted(i for row in got for i in row) == list(range(300))
    assert sorted(most - sum(lengths[i] for i in row) for row in got) == sorted(room)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(pk, "BLOCK_TOKENS", 3000)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "cat", "naïve", "🙂", "12"]) for _ in range(r.choice([0, 3, 50, 700])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 30000), (7, rows[7][1]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    packed = pk.pack(df, ENC, END, row_tokens=128)
    out = packed.collect()
    encode = ENC()
    for x in out:
        ids, pos = np.frombuffer(x.ids, "<u2"), np.frombuffer(x.positions, "<u2")
        assert len(ids) == len(pos) == 128 and x.n_tokens == x.cu_seqlens[-1] and (ids[x.n_tokens:] == END).all()
        for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
    assert len({x.row_id for x in out}) == len(out)
    docs = {}
    for s in sorted(pk.unpack(packed, END).collect(), key=lambda s: s.start):
        docs.setdefault(s.doc_id, []).append(s)
    want = {i: encode(t or "") for i, t in rows}
    for i, ids in want.items():
        times = 2 if i == 7 else 1
        assert sum(s.last for s in docs[i]) == times
        assert [x for s in docs[i][::times] for x in s.ids] == ids
    assert set(docs) == set(want)
    total = sum(len(v) + 1 for v in want.values()) + len(want[7]) + 1
    assert sum(x.n_tokens for x in out) == total


def test_empty_table_extra_columns_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "the cat", "z", 4)], "doc_id int, text string, ids string, row_id int")
    packed = pk.pack(df, ENC, END, row_tokens=16)
    pk.write_packed(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert [r.ids for r in pk.unpack(back, END).collect()] == [ENC()("the cat")]
    assert pk.pack(df.where("false"), ENC, END).collect() == []
