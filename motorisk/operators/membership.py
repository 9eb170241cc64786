"""Rows whose key may be among a set of keys, found without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most bits of a key filter (1 MB).
FILTER_BITS = 1 << 23


def long_array(values: Sequence[int]) -> Column:
    """A constant array of integers; one text literal for the planner, folded into an array."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def likely_members(df: DataFrame, key: str, members: DataFrame, member: str, n: int) -> DataFrame:
    """Rows of ``df`` whose key may be among the ``n`` members: all that are and
    few others, found without a shuffle of ``df``. A hash bitmap of 16 bits a
    member, up to ``FILTER_BITS``, travels as a literal; a fuller bitmap lets more
    rows pass, so the exact join must follow."""
    bits = 64
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)).cast("int")
    got = (members.select(place(member).alias("b")).groupBy(F.shiftright("b", 6).alias("word"))
           .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63))).alias("on")).collect())
    words = [0] * (bits // 64)
    for r in got:
        words[r.word] = r.on
    b = place(key)
    on = F.get(long_array(words), F.shiftright(b, 6))
    return df.where(F.call_function("shiftrightunsigned", on, b.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1)
