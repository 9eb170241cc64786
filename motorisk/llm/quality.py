"""Operator 7: quality classifier by importance resampling.

Two generative bag-of-n-grams models over hashed n-grams, one of target text
(documents labelled good) and one of all raw text, give every document a log
importance weight: the sum of log(target / raw) over its n-grams. Documents are
drawn without replacement in proportion to their weights by Gumbel top-k: the
k largest of log weight + Gumbel noise stay.

N-grams: words and word pairs (bytes, A-Z as a-z), and runs of one to three
word shapes (letter case, trailing signs, length class, repeats the word
before), so that layout counts beside vocabulary. k defaults to the number of
documents whose weight is above exp(-``MARGIN``): noise then hardly ever moves
a document the target model explains, and text far below it goes.

Raw counts cover all documents. The target model is fitted on at most
``FIT_ROWS`` labelled rows (the lowest of a seeded hash of the id), whose ids
alone are broadcast. Its probabilities are smoothed towards the raw model, so
with little labelled text the weights shrink to 0 and every document stays.

Weights are sums of integers (units of 2^-20), hence equal on every run.

Defined cases: a text that is null, empty or without words has weight 0; texts
are read whole; equal rows get equal weights and noise, and ties at the cut
all stay; without good labels or in an empty table all rows stay; further columns
are kept as they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import Stages, free_name

#: Labelled rows the target model is fitted on, at most; bounds the broadcast ids (0.4 MB).
FIT_ROWS = 50_000
#: Hash buckets: words, word pairs, shapes.
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 15, 1 << 14
BUCKETS = 2 * WORD_BUCKETS + SHAPE_BUCKETS
#: Pseudo-counts of the raw model per bucket in the target model.
SMOOTH = 20.0
#: Documents with a log weight above minus this count into k.
MARGIN = 4.0
UNIT = float(1 << 20)
SEED = 7
#: Bytes of text whose n-grams a task holds at once; arrays of about forty times that size.
SLICE_BYTES = 256 << 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"()-"]] = True


def _shapes(data: np.ndarray, offs: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A small code per word: letter case, signs at its end, length class, whether it repeats the word before."""
    solid = ~tb._SPACE[data]
    first = np.zeros(len(data), bool)
    first[offs[:-1][offs[:-1] < len(data)]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:]
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(data))
    count = lambda table: np.add.reduceat(table[data], start, dtype=np.int64)  # noqa: E731  blanks after a word count 0
    up, low, sign, common, size = (count(t) for t in (_UPPER, _LOWER, _SIGN, _SIGN & _COMMON, ~tb._SPACE))
    case = np.where(up + low == 0, 3, np.where((low == 0) & (up > 1), 2, np.where(up > 0, 1, 0)))
    odd = np.minimum(sign - common, 3)
    length = np.searchsorted([2, 4, 8, 16, 32], size, side="right")
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    del stop
    return ((((case * 4 + odd) * 3 + np.minimum(common, 2)) * 6 + length) * 2 + same).astype(np.uint64) + np.uint64(1)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and its row."""
    h, row, _ = tb.words(data, offs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = _shapes(data, offs, h, row)
    pair = row[1:] == row[:-1]
    triple = pair[1:] & pair[:-1]
    words, shapes = np.uint64(WORD_BUCKETS), np.uint64(SHAPE_BUCKETS)
    s2 = shape[:-1] * tb._Q + shape[1:]
    s3 = s2[:-1] * tb._Q + shape[2:]
    parts = [(h % words, row),
             (tb.mix(h[:-1] * tb._Q + h[1:])[pair] % words + words, row[1:][pair])]
    for g, r in ((shape, row), (s2[pair], row[1:][pair]), (s3[triple], row[2:][triple])):
        parts.append((tb.mix(g) % shapes + np.uint64(2 * WORD_BUCKETS), r))
    return np.concatenate([b.astype(np.int64) for b, _ in parts]), np.concatenate([r for _, r in parts])


def _counts(batches):
    """Counts of all rows (text in column 0) and of the target rows (column 1) by bucket."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        data, offs = tb.text_buffer(b.column(0))
        good = np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
        for i, j in tb.slices(offs, SLICE_BYTES):
            bucket, row = features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[i:j][row]], minlength=BUCKETS)
    hit = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])],
                                     names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: Column | None = None,
        rows: int = FIT_ROWS) -> np.ndarray:
    """Log ratio of every bucket in units of 2^-20 (``BUCKETS`` integers)."""
    good = F.col("quality") == 1 if good is None else good
    sample = (labels.where(good & F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()
              .orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows).withColumn("_good", F.lit(True)))
    marked = docs.select(F.col(text).alias("t"), F.col(key).alias("_id")).join(F.broadcast(sample), "_id", "left")
    got = (marked.select("t", "_good").mapInArrow(_counts, "bucket long, raw long, target long")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())   # one row per bucket
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in got:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = np.zeros(BUCKETS)
    for a, b in ((0, WORD_BUCKETS), (WORD_BUCKETS, 2 * WORD_BUCKETS), (2 * WORD_BUCKETS, BUCKETS)):
        if target[a:b].sum() == 0:
            continue
        q = raw[a:b] / raw[a:b].sum()
        extra = SMOOTH * (b - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (target[a:b] + extra * q) / (target[a:b].sum() + extra)
            ratio[a:b] = np.where(q > 0, np.log(p / q), 0.0)
    return np.rint(ratio * UNIT).astype(np.int64)


def score(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "weight") -> DataFrame:
    """``df`` with ``out``: the log weight of ``text`` in units of 2^-20."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        table = shared.value
        for b in batches:
            data, offs = tb.text_buffer(b.column(at))
            for i, j in tb.slices(offs, SLICE_BYTES):
                bucket, row = features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                total = np.zeros(j - i, np.int64)
                np.add.at(total, row, table[bucket])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total)], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def gumbel_key(weight: Column, key: Column, seed: int = SEED) -> Column:
    """Log weight plus Gumbel noise drawn from a hash of the key."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return weight / F.lit(UNIT) - F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int, cells: int = 1024) -> float:
    """The k-th largest value of ``col``: histograms of the range that holds it,
    narrower every round, until one value is left. ``cells`` counts reach the
    driver a round."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    above = 0                                        # rows over hi
    while lo < hi:
        width = (hi - lo) / cells
        cell = F.least(F.lit(cells - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("long"))
        got = (df.where(F.col(col).between(lo, hi)).groupBy(cell.alias("c"))
               .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect())
        for r in sorted(got, key=lambda r: -r.c):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo


def cut(scored: DataFrame, key: str = "doc_id", weight: str = "weight", k: int | None = None, seed: int = SEED) -> float:
    """Smallest Gumbel key that stays: the k-th largest of all rows."""
    keyed = scored.select(F.col(weight).alias("w"), gumbel_key(F.col(weight), F.col(key), seed).alias("g"))
    n, fine = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("w") > -MARGIN * UNIT).cast("long")), F.lit(0))).first()
    k = fine if k is None else min(k, n)
    if k <= 0:
        return float("inf")
    if k >= n:
        return float("-inf")
    return kth_largest(keyed, "g", k)


def decisions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
              seed: int = SEED) -> DataFrame:
    """(key, log_weight, gumbel_key, kept) of every row."""
    st = Stages(docs.sparkSession)
    scored = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), fit(docs, labels, key, text), "text")
    scored = st.write(scored.select("key", "weight"), "weights")
    least = cut(scored, "key", "weight", k, seed)
    g = gumbel_key(F.col("weight"), F.col("key"), seed)
    return scored.select(F.col("key").alias(key), (F.col("weight") / UNIT).alias("log_weight"), g.alias("gumbel_key"),
                         (g >= F.lit(least)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None,
              seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, unchanged. The decision is a
    function of the row and the cut, so rows are scored again where they lie
    instead of being joined with their decisions."""
    st = Stages(docs.sparkSession)
    model = fit(docs, labels, key, text)
    weights = st.write(score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, "text")
                       .select("key", "weight"), "weights")
    least = cut(weights, "key", "weight", k, seed)
    st.close()
    name = free_name(docs.columns, "weight")
    return (score(docs, model, text, name).where(gumbel_key(F.col(name), F.col(key), seed) >= F.lit(least))
            .select(*docs.columns))
