"""Reproducible train / test splits and seeded shuffles.

A split labels every row where it lies: the threshold between train and test
is found first, on the key (and order) columns alone, and rows are compared
with it. No row is shuffled or written. Sizes are exact and do not depend on
how the input is partitioned; rows with equal keys land on the same side.

The random order is ``md5(key ‖ seed)``, a value both Spark and SQL engines
compute identically; the key breaks the (practically impossible) hash ties.
Its threshold comes from counts per leading hex digits, refined inside the
cell that holds the cut. The threshold of a given order comes from the
distributed row index of the narrow columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from . import ordering as O
from .materialize import materialize

# Hash buckets per shuffle partition: several per partition even out the
# partitions that receive more than one bucket.
BUCKETS_PER_PARTITION = 4
# Most rows of the cell with the cut whose keys are listed to find it.
SORTED_ROWS = 10_000

SPLIT = "split"
TRAIN, TEST = "train", "test"


def _check_ratio(test_ratio: float) -> None:
    if not 0 < test_ratio < 1:
        raise ValueError(f"test_ratio must be between 0 and 1, got {test_ratio}")


def shuffle_key(key: str, seed: int) -> Column:
    """Seeded pseudo-random sort key of a row; a NULL key hashes as a value of its own."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\u0000")), F.lit(str(seed))))


def shuffle_bucket(hash_hex: Column, buckets: int) -> Column:
    """Bucket of a hex hash that never decreases along the hash order: the
    first 8 hex digits, scaled to ``buckets`` (uniform, so buckets are even)."""
    prefix = F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long")
    return F.floor(prefix * F.lit(buckets) / F.lit(float(1 << 32))).cast("int")


def _hash_order(df: DataFrame, key: str, seed: int, out: str):
    n = shuffle_partitions(df.sparkSession)
    h = shuffle_key(key, seed)
    return O.row_index_and_count(df, [h, F.col(key)], out, bucket=shuffle_bucket(h, BUCKETS_PER_PARTITION * n))


def shuffle_order(df: DataFrame, key: str, seed: int = 42, out: str = "shuffle_position") -> DataFrame:
    """A seeded permutation, as the position of each row."""
    return _hash_order(df, key, seed, out)[0]


def _literal(row, schema) -> Column:
    """The values of ``row`` as a struct of typed literals."""
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])


def _hash_threshold(keys: DataFrame, key: str, seed: int, share: Callable[[int], int]):
    """(rows, (hash, key) of the last of the first ``share(rows)`` rows in hash order).

    Counts per four hex digits (at most 65,536 rows a round), then the same
    inside the cell with the cut, until few enough rows are left to sort."""
    hashed = keys.select(shuffle_key(key, seed).alias("h"), F.col(key).alias("key"))
    prefix, total, left = "", None, None
    while True:
        at = len(prefix)
        cells = sorted((r.c, r.n) for r in hashed.where(F.col("h").startswith(prefix))
                       .groupBy(F.substring("h", at + 1, 4).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
        if total is None:
            total = sum(n for _, n in cells)
            left = share(total)
            if left <= 0:
                return total, None
        for c, n in cells:
            if left <= n:
                prefix += c
                break
            left -= n
        if n <= SORTED_ROWS or len(prefix) >= 32:
            # at most SORTED_ROWS rows, or the keys of one hash; a key's rows are counted, never gathered
            values = hashed.where(F.col("h").startswith(prefix)).groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"))
            for r in sorted(values.collect(), key=lambda r: (r.h, r.key is not None, r.key if r.key is not None else 0)):
                left -= r.n
                if left <= 0:
                    return total, r


def split_data(df: DataFrame, key: str, test_ratio: float = 0.2, shuffle: bool = True,
               seed: int = 42, order: Sequence[str] | None = None) -> DataFrame:
    """Adds ``split`` = train / test. Test size is ceil(n · ratio); an
    empty train set is an error, as in the reference's splitter.

    With ``shuffle`` the test rows are the first ones of the seeded order;
    without, the last rows of ``order`` (default: the key) are the test set."""
    _check_ratio(test_ratio)
    if not shuffle:
        return _split_at(df, [*(order or [key]), key], lambda n: n - math.ceil(n * test_ratio), test_ratio)
    keys = materialize(df.select(key), "keys")
    n, last = _hash_threshold(keys, key, seed, lambda rows: math.ceil(rows * test_ratio))
    _check_train(n, n - math.ceil(n * test_ratio), test_ratio)
    here = F.struct(shuffle_key(key, seed).alias("h"), F.col(key).alias("key"))
    limit = F.struct(F.lit(last.h).alias("h"), F.lit(last.key).cast(df.schema[key].dataType).alias("key"))
    return df.withColumn(SPLIT, F.when(here <= limit, TEST).otherwise(TRAIN))


def _check_train(n: int, train: int, test_ratio: float) -> None:
    if train <= 0:
        raise ValueError(f"with {n} rows and test_ratio={test_ratio} the train set would be empty")


def _split_at(df: DataFrame, order: Sequence[str | Column], train_rows: Callable[[int], int], test_ratio: float,
              may_be_empty: bool = False) -> DataFrame:
    """The first ``train_rows(n)`` rows in ``order`` are train."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"o{i}" for i in range(len(columns))]
    narrow = df.select(*[c.alias(n) for c, n in zip(columns, names)])
    idx, n = O.row_index_and_count(narrow, names, "_i")
    cut = train_rows(n)
    if not may_be_empty:
        _check_train(n, cut, test_ratio)
    first = idx.where(F.col("_i") == cut).select(*names).first()     # first test row
    if first is None:
        return df.withColumn(SPLIT, F.lit(TRAIN))
    here = F.struct(*[c.alias(n) for c, n in zip(columns, names)])
    return df.withColumn(SPLIT, F.when(here >= _literal(first, narrow.schema), TEST).otherwise(TRAIN))


def split_ordered(df: DataFrame, order: Sequence[str | Column], key: str, test_ratio: float = 0.2) -> DataFrame:
    """The first int(n · (1 − ratio)) rows in ``order`` are train."""
    _check_ratio(test_ratio)
    return _split_at(df, [*order, key], lambda n: int(n * (1 - test_ratio)), test_ratio, may_be_empty=True)


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of a split frame."""
    return df.where(F.col(SPLIT) == TRAIN), df.where(F.col(SPLIT) == TEST)
