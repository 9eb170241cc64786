"""Moments of columns and of all pairs of them in one pass.

A task reads its rows in Arrow batches and keeps, per pair of columns, the rows
in which both are present, their means and centred sums of squares and products:
a few numbers per pair, whatever the rows. Batches and tasks are put together by
the rule for two parts (Chan et al.), so nothing cancels, and a column that does
not vary has a sum of squares of exactly 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import Stages

# Tasks carry this module's code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = ("x int, y int, n long, mx double, my double, xx double, yy double, xy double, "
         "total double, low double, high double, endless boolean")


class _Sums:
    """Entries [i, j] are taken on the rows in which columns i and j are present:
    their number, the mean of i, its centred squares, the products of i and j."""

    def __init__(self, k: int):
        self.n, self.mean, self.squares, self.products = (np.zeros((k, k)) for _ in range(4))
        self.total, self.low, self.high = np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf)
        self.endless = np.zeros(k, bool)

    def add_rows(self, x: np.ndarray) -> None:
        """Rows of doubles, NaN where missing."""
        k, present = x.shape[1], ~np.isnan(x)
        batch = _Sums(k)
        alike: dict[bytes, list[int]] = {}                    # columns missing on the same rows
        for j in range(k):
            alike.setdefault(present[:, j].tobytes(), []).append(j)
            v = x[present[:, j], j]
            if len(v):
                self.total[j] += v.sum()
                self.low[j], self.high[j] = min(self.low[j], v.min()), max(self.high[j], v.max())
                self.endless[j] |= bool(np.isinf(v).any())
        for a, b in combinations_with_replacement(alike.values(), 2):
            here = present[:, a[0]] & present[:, b[0]]
            if not here.any():
                continue
            cols = a if a is b else a + b
            z = x[:, cols] if here.all() else x[np.ix_(here, cols)]
            mean = z[0] + (z - z[0]).mean(axis=0)
            d = z - mean
            left = d.sum(axis=0)
            c = d.T @ d - np.outer(left, left) / len(z)
            squares = np.maximum(np.diag(c), 0)
            ia, ib = slice(0, len(a)), slice(0, len(a)) if a is b else slice(len(a), None)
            for one, other, i, j in ((a, b, ia, ib), (b, a, ib, ia)):
                at = np.ix_(one, other)
                batch.n[at], batch.mean[at], batch.squares[at], batch.products[at] = len(z), mean[i, None], squares[i, None], c[i, j]
        self._merge(batch)

    def _merge(self, b: _Sums) -> None:
        n = self.n + b.n
        share = np.divide(b.n, n, out=np.zeros_like(n), where=n > 0)
        delta = np.where(b.n > 0, b.mean - self.mean, 0.0)
        self.products += b.products + delta * delta.T * self.n * share
        self.squares += b.squares + delta * delta * self.n * share
        self.mean += delta * share
        self.n = n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = None
    with np.errstate(all="ignore"):
        for b in batches:
            if b.num_rows:
                sums = sums or _Sums(b.num_columns)
                sums.add_rows(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
    if sums is None:
        return
    i, j = np.nonzero(np.triu(sums.n))
    own = i == j
    only = lambda a: pa.array(a[i], mask=~own)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.n[i, j].astype(np.int64)), pa.array(sums.mean[i, j]), pa.array(sums.mean[j, i]),
         pa.array(sums.squares[i, j]), pa.array(sums.squares[j, i]), pa.array(sums.products[i, j]),
         only(sums.total), only(sums.low), only(sums.high), only(sums.endless)],
        names=["x", "y", "n", "mx", "my", "xx", "yy", "xy", "total", "low", "high", "endless"])


def pair_moments(df: DataFrame, columns: Sequence[str], stages: Stages) -> DataFrame:
    """(feature, item, n, mean, low, high, sd, cxy, vx, vy): a row per column with
    values (item NULL; n, mean, extremes, sample deviation, NULL with an infinite
    value) and a row per pair of columns, in their order, that share rows (n,
    sample covariance and variances on them). NULL and NaN are missing."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = stages.write(doubles.mapInArrow(_sums, PARTS), "moments")
    # from a mean of its own a part's distance is small, and 0 where nothing varies
    near = parts.groupBy("x", "y").agg(F.min("mx").alias("cx"), F.min("my").alias("cy"))
    n, u, w = F.col("n"), F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    whole = parts.join(near, ["x", "y"]).groupBy("x", "y").agg(
        F.sum("n").alias("n"), F.sum(n * u).alias("u"), F.sum(n * w).alias("w"), F.sum(F.col("xx") + n * u * u).alias("xx"),
        F.sum(F.col("yy") + n * w * w).alias("yy"), F.sum(F.col("xy") + n * u * w).alias("xy"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("endless").alias("endless"))

    def sample(squares, a, b):
        return F.when(n > 1, (F.col(squares) - F.col(a) * F.col(b) / n) / (n - 1))

    name = lambda i: F.get(F.array(*[F.lit(c) for c in columns]), F.col(i))
    vx, vy = F.greatest(sample("xx", "u", "u"), F.lit(0.0)), F.greatest(sample("yy", "w", "w"), F.lit(0.0))
    vx, vy = F.when(n > 1, vx), F.when(n > 1, vy)
    own = F.col("x") == F.col("y")
    return whole.select(
        name("x").alias("feature"), F.when(~own, name("y")).alias("item"), "n", F.when(own, F.col("total") / n).alias("mean"), "low", "high",
        F.when(own & ~F.col("endless"), F.sqrt(vx)).alias("sd"), F.when(~own, sample("xy", "u", "w")).alias("cxy"),
        F.when(~own, vx).alias("vx"), F.when(~own, vy).alias("vy"))
