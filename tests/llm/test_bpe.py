"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from motorisk.llm import bpe
from tokenizers import Tokenizer as Library

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a<|endoftext|>b <|startoftext|>", "<| endoftext|> <|endoftext", "Σ ΑΣ ΟΔΟΣ İstanbul ǅ", "é ́x",
       "x\x1cy\x1f z", "½ ² Ⅷ ٣٤ x_y 'S it's DON'T we'll i'd", "日本語テスト mixed中abc", "a" * 5000, "ab" * 900 + "the",
       "🙂👩‍👩‍👧", "　q​z", "ﬁ ß ẞ", "'s's't're", "\x00 \x85 a\x85b", "1234 12a34", "the the", "the the", "unassigned ͹ ՘x"]


def _noise(n):
    r = random.Random(3)
    spans = ((32, 127), (0xA0, 0x250), (0x300, 0x600), (0x2000, 0x2100), (0x4E00, 0x4E50), (0x1F600, 0x1F650), (32, 33))
    return ["".join(chr(r.randrange(*r.choice(spans))) for _ in range(r.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_same_ids_and_text_as_library(spark, library):
    texts = ODD + _noise(600)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode_digests(df, PATH).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(texts):
        ids = library.encode(s or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_finds_its_words_only():
    words = {w: [i, i + 1] for i, w in enumerate(["", "tap", "taps", "top", "tops", "stop", "é", "日本"])}
    lex = bpe.Lexicon(bpe.Lexicon.compile(words))
    got = lex.find(list(words))
    assert {w: list(struct.unpack("<2i", x)) for w, x in zip(words, got)} == words
    assert lex.find(["t", "ta", "tapss", "sto", "x", "本"]) == [None] * 6
    big = {f"{a}{b}ing": [1] for a in "abcdefgh" for b in "abcdefgh"}
    assert len(bpe.Lexicon(bpe.Lexicon.compile(big)).final) < 30        # suffixes are shared


def test_lexicon_changes_nothing(spark, library):
    df = spark.createDataFrame([(1, "the cat the cat zzqx"), (2, "the dog")], "doc_id long, text string")
    with_lex = bpe.encode(df, PATH).orderBy("doc_id").collect()
    without = bpe.encode(df, PATH, lexicon=b"").orderBy("doc_id").collect()
    assert with_lex == without
    assert list(with_lex[0].ids) == library.encode("the cat the cat zzqx", add_special_tokens=False).ids


def test_empty_table_extra_columns_and_clashes(spark):
    empty = spark.createDataFrame([], "text string, doc_id long, ids long")
    assert bpe.encode(empty, PATH, out="codes").collect() == []
    with pytest.raises(ValueError):
        bpe.encode(empty, PATH, out="IDS")
    df = spark.createDataFrame([("x", "the", None)], "decoded string, text string, n int")
    out = bpe.decode(bpe.encode(df, PATH), PATH, out="back").first()
    assert (out.decoded, out.text, out.n, out.back) == ("x", "the", None, "the</w>")


def test_decode_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([320, 999999],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == [None, "", bpe.Tokenizer(PATH).token[320]]


def test_words_outside_the_lexicon_are_merged_together(library, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeéstß日🙂") for _ in range(r.randrange(1, 30))) for _ in range(1500)]
    words += ["a" * n for n in (1, 11, 12, 13, 24, 25, 47, 48, 49, 300)] + ["the", "ab" * 20, "日本" * 8]
    alone = []
    merge = bpe.Tokenizer.merge
    monkeypatch.setattr(bpe.Tokenizer, "merge", lambda self, w: alone.append(w) or merge(self, w))
    got = bpe.Encoder(bpe.Tokenizer(PATH), None).encode([" ".join(words), "", words[0].upper()])
    ids = library.encode(" ".join(words), add_special_tokens=False).ids
    assert got[0] == struct.pack(f"<{len(ids)}I", *ids) and got[1] == b""
    assert list(struct.unpack(f"<{len(got[2]) // 4}I", got[2])) == library.encode(words[0].upper(), add_special_tokens=False).ids
    assert alone and all(len(w.encode()) > 48 for w in alone)


def test_decode_leaves_out_nulls_and_ids_without_string(spark):
    token = bpe.Tokenizer(PATH).token
    the = next(i for i, s in token.items() if s == "the</w>")
    rows = [([the, None, -5, the],), (None,), ([10 ** 7],), ([the],)]
    df = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == ["the</w> the</w>", None, "", "the</w>"]
    codes = spark.createDataFrame([(struct.pack("<3I", the, 2 ** 32 - 1, the),), (None,), (b"",)], "ids binary").coalesce(1)
    assert [r.decoded for r in bpe.decode(codes, PATH).collect()] == ["the</w> the</w>", None, ""]
