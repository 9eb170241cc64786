"""Operator 6: toxicity by noisy-channel deobfuscation.

A token that looks disguised (signs or digits among letters, letters repeated
three times or more, single letters spaced out) is a lattice: every observed
sign may stand for itself or for the letters it imitates, a repeated sign may
be a stutter, a separator may be padding. Viterbi picks the most likely word
under a character trigram model of the corpus times the channel's costs. The
restored words are then scored.

The character model counts the trigrams of all documents. Word weights are log
odds between toxic and other labelled training rows, for whole words and for
word beginnings (inflected forms). A feature must follow at least ``CONTEXTS``
different words in toxic rows, so that copies of one document teach nothing
but what they share with others. A text's log odds are the prior plus the best
weight of each of its distinct words; the score is their logistic value.

Labels, language, source and id are never inputs of a score; ``train`` says
which labelled rows may teach. At most ``FIT_ROWS`` of them are used (the
lowest of a seeded hash), whose ids and labels are broadcast.

Defined cases: null, empty or wordless text scores the prior; whole texts are
read, however long; equal texts get equal scores; without labels all texts
score 0.5; an empty table stays empty; other columns are kept, and the output
column must be new."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

FIT_ROWS = 50_000
#: Least different words before a feature, least weight, most features shipped, lengths of word beginnings.
CONTEXTS, LEAST_WEIGHT, MOST_FEATURES, STEMS = 6, 3.0, 50_000, (3, 4, 5, 6, 7, 8)
#: Tokens a task remembers; features it counts before it passes them on.
MEMO, COUNTED = 200_000, 200_000
#: Taken off every weight, for features are chosen and weighed on the same rows.
CAUTION = 2.0
THRESHOLD, SEED = 0.7, 3

# Letters that digits and signs imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = frozenset(".-_*'\"`~,;:/\\ ")
#: Log costs of the channel: an imitated letter, a stutter, padding, a sign kept as it is.
IMITATED, STUTTER, PADDED, KEPT = -2.0, -1.0, -1.0, -9.0

_EDGE = "\"'()[]{}<>.,;:!?*#%&$|~`"
#: Readings of a token keep this many runs of imitating signs at either end, and all of them.
EDGE_RUNS = 3
_IMITATING = re.compile("([" + re.escape("".join(IMITATES)) + r"])\1*")
_PLAIN = re.compile(r"^[^\W\d_]+$")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:][ .\-_*]){3,}[^\s.,;:](?!\S)")
_TOKEN = re.compile(r"\S+")
SYMBOLS = 28                                        # word edge, a-z, any other letter


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(batches):
    """Counts of (before, before, sign) over the letters of all texts (column 0)."""
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for b in batches:
        data, offs = tb.text_buffer(b.column(0))
        for i, j in tb.slices(offs, 4 << 20):
            s = _CLASS[data[offs[i]:offs[j]]]
            s = np.concatenate([[0, 0], s, [0]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["g", "n"])


class CharacterModel:
    """Log probability of a letter after two others; unseen ones fall back smoothly."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c[0, 0, 0] = 0                              # blanks between words
        one = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
        three = (c + 5 * two[None]) / (c.sum(2)[:, :, None] + 5)
        self.log = np.log(three).tolist()

    def restore(self, token: str, kept: frozenset = frozenset()) -> str:
        """Most likely word behind ``token`` (lower case); signs at the places ``kept`` are no stutter."""
        # state: last two symbols -> (log score, path as linked pairs)
        states = {(0, 0): (0.0, None)}
        before = ""
        for i, o in enumerate(token):
            moves = [(o, 0.0)] if o.isalpha() else [(c, IMITATED) for c in IMITATES.get(o, "")]
            skip = STUTTER if o == before and i not in kept else PADDED if o in SEPARATORS else None
            if not moves and skip is None:
                moves = [(o, KEPT)]
            nxt: dict = {}
            for (a, b), (score, path) in states.items():
                if skip is not None and ((a, b) not in nxt or nxt[a, b][0] < score + skip):
                    nxt[a, b] = (score + skip, path)
                row = self.log[a][b]
                for c, cost in moves:
                    s = _symbol(c)
                    got = score + row[s] + cost
                    if (b, s) not in nxt or nxt[b, s][0] < got:
                        nxt[b, s] = (got, (path, c))
            states, before = nxt, o
        best = max(states.items(), key=lambda x: (x[1][0] + self.log[x[0][0]][x[0][1]][0], x[0]))[1][1]
        out = []
        while best is not None:
            best, c = best
            out.append(c)
        return "".join(reversed(out))


def _decoded(readings, model: CharacterModel) -> list[str]:
    """Words behind the readings; signs that stand exactly twice ('a$$') are also read as two letters."""
    out = []
    for x in readings:
        out.append(model.restore(x))
        twice = frozenset(m.end() - 1 for m in _IMITATING.finditer(x) if len(m.group()) == 2)
        if twice:
            out.append(model.restore(x, twice))
    return [w for w in dict.fromkeys(out) if w]


def _edge_readings(chunk: str, bare: str) -> list[str]:
    """Readings of ``chunk`` that keep imitating signs at its ends, which can be
    letters ('$tupid') or punctuation ('stupid!'): none of them, the nearest
    runs of equal signs one by one, and all; empty without an imitating sign."""
    if not any(c in IMITATES for c in chunk):
        return []
    at = chunk.index(bare) if bare else 0
    end = at + len(bare) if bare else len(chunk)
    runs = [m.span() for m in _IMITATING.finditer(chunk)]
    before, after = [a for a, b in runs if b <= at], [b for a, b in runs if a >= end]
    starts = dict.fromkeys([at, *before[::-1][:EDGE_RUNS], *before[:1]])
    ends = dict.fromkeys([end, *after[:EDGE_RUNS], *after[-1:]])
    return list(dict.fromkeys(chunk[a:b] for a in starts for b in ends))


def words_of(chunk: str, model: CharacterModel) -> list[str]:
    """Restored words of one token between blanks (lower case)."""
    bare = chunk.strip(_EDGE)
    if not any(c.isalpha() for c in bare):
        # imitating signs alone can be a word: with those at its ends, and without
        return _decoded(_edge_readings(chunk, bare), model)
    if _PLAIN.match(bare):
        plain = [bare, model.restore(bare)] if _RUN.search(bare) else [bare]
        if len(bare) == len(chunk):
            return plain
        return list(dict.fromkeys(plain + _decoded((x for x in _edge_readings(chunk, bare) if x != bare), model)))
    # a disguised word, or several words with signs between them
    whole = chunk.strip("\"'()[]{}.,;:?")
    readings = dict.fromkeys([whole, bare, *_edge_readings(chunk, bare)])
    return list(dict.fromkeys([*_decoded(readings, model), *re.findall(r"[^\W\d_]+", bare)]))


def features_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in STEMS if len(word) >= k)]


class Reader:
    """Texts to restored words, remembering tokens."""

    def __init__(self, model: CharacterModel, of=lambda words: words, most: int = MEMO):
        self.model, self.of, self.memo, self.most = model, of, {}, most

    def token(self, chunk: str):
        if len(self.memo) >= self.most:
            self.memo.clear()
        got = self.memo[chunk] = self.of(words_of(chunk, self.model))
        return got

    def spaced(self, text: str) -> list:
        return [self.of([self.model.restore(m.group().strip())]) for m in _SPACED.finditer(text)]

    def read(self, text: str) -> list:
        low = text.lower()
        memo, token = self.memo, self.token
        return [memo[c] if c in memo else token(c) for c in low.split()] + self.spaced(low)


def train_rows(key: Column) -> Column:
    """Rows whose labels may teach: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def _count_features(shared):
    schema = pa.schema([("f", pa.string()), ("pos", pa.int64()), ("neg", pa.int64()), ("ctx", pa.int64())])

    def run(batches):
        def of(words):
            """Features of a token, and the mark it sets for the token behind it."""
            return (tuple({f for w in words for f in features_of(w)}), 1 << (zlib.crc32(words[0].encode()) & 63)) if words else None
        reader = Reader(shared.value, of, MEMO // 4)
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

        def passed_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(
                pa.array([v[i] - (1 << 64) if v[i] >= 1 << 63 else v[i] for v in seen.values()], pa.int64()) for i in range(3))], schema=schema)
            seen.clear()
            return out
        for b in batches:
            for t, label in zip(b.column(0), b.column(1).to_pylist()):
                found: dict[str, int] = {}
                before = 1
                for token in reader.read(t.as_py() or ""):
                    if token is not None:
                        for f in token[0]:
                            found[f] = found.get(f, 0) | before
                        before = token[1]
                for f, ctx in found.items():
                    v = seen[f]
                    v[0 if label else 1] += 1
                    if label:
                        v[2] |= ctx
                if len(seen) > COUNTED:
                    yield passed_on()
        yield passed_on()
    return run


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    got = (docs.select(text).mapInArrow(trigram_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
           .collect())                              # at most SYMBOLS cubed rows
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    for r in got:
        counts[r.g] = r.n
    return CharacterModel(counts)


def fit(docs: DataFrame, labels: DataFrame, model: CharacterModel, key: str = "doc_id", text: str = "text",
        label: str = "toxic", train: Column | None = None, rows: int = FIT_ROWS) -> tuple[float, dict[str, float]]:
    """(prior log odds, weight of every feature kept)."""
    sc = docs.sparkSession.sparkContext
    train = train_rows(F.col(key)) if train is None else train
    sample = (labels.where(train & F.col(key).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
              .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows))
    marked = docs.select(F.col(text).alias("t"), F.col(key).alias("_id")).join(F.broadcast(sample), "_id").select("t", "_label")
    n = {r["_label"]: r.n for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    counted = (marked.mapInArrow(_count_features(sc.broadcast(model)), "f string, pos long, neg long, ctx long")
               .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_or("ctx").alias("ctx")))
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    kept = (counted.where(F.bit_count("ctx") >= CONTEXTS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
            .orderBy(F.desc("w"), "f").limit(MOST_FEATURES).collect())
    return math.log((pos + 1) / (neg + 1)), {r.f: r.w - CAUTION for r in kept}


def score(df: DataFrame, model: CharacterModel, prior: float, weights: dict[str, float], text: str = "text",
          out: str = "score") -> DataFrame:
    """``df`` with ``out``, the score of ``text`` (0 to 1)."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out!r} exists already; name another output column")
    shared = df.sparkSession.sparkContext.broadcast((model, weights))
    at = df.columns.index(text)

    def run(batches):
        model, weights = shared.value

        def of(words):
            """The heaviest (weight, word) of a token, or None."""
            got = [(w, word) for word in words for f in features_of(word) if (w := weights.get(f)) is not None]
            return max(got) if got else None
        reader = Reader(model, of)
        for b in batches:
            scores = []
            for t in b.column(at):
                best: dict[str, float] = {}
                for hit in {*reader.read(t.as_py() or "")} - {None}:
                    best[hit[1]] = max(hit[0], best.get(hit[1], hit[0]))
                odds = prior + math.fsum(best.values())
                scores.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    model = character_model(docs, text)
    prior, weights = fit(docs, labels, model, key, text)
    scored = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, prior, weights)
    return scored.select(F.col("key").alias(key), (~train_rows(F.col("key"))).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
