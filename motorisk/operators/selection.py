"""Rows at given positions of an order, without sorting the rows.

A position is looked for digit by digit. An order column is mapped to a 64-bit
integer with the same order (``order_image``), and each pass counts the rows per
next digit (12 or 13 bits) inside the brackets that still hold more than one
value; the counts say which cell holds the position. A column takes at most
five passes whatever its values are, infinities and denormal numbers included,
and digits on which a bracket's ends agree are skipped. A pass is an equi-join with
the open brackets (a row per group and position) and a map-side combined count:
no row is shuffled by value or sorted, and a hot value is one row of the counts.

Ties of the first order column go on to the second, and so on, so a position of
(prediction, key) is a single row when keys differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .materialize import Stages

# Lowest bit of each digit, and the bits of all digits but the first.
SHIFTS, BITS = (52, 39, 26, 13, 0), 13


def order_image(x: Column) -> Column:
    """A long that orders doubles as ``<`` does (-0.0 and 0.0 alike, infinities at
    the ends): sign times the bits of the absolute value, that is its exponent
    and, below, the 52 bits of its fraction. NULL for NULL; NaN must be left out."""
    a = F.abs(x)
    near = _near(a)
    return _bits(x, a, near, _part(a, near))


def _near(a: Column) -> Column:
    """The exponent of ``a`` or one beside it."""
    return F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a)).cast("double")))


def _part(a: Column, near: Column) -> Column:
    return a / F.pow(F.lit(2.0), near)


def _bits(x: Column, a: Column, near: Column, part: Column) -> Column:
    exponent = near + F.when(part >= 2, 1.0).when(part < 1, -1.0).otherwise(0.0)
    fraction = F.when(part >= 2, part / 2).when(part < 1, part * 2).otherwise(part) - 1
    normal = (exponent + 1023).cast("long") * (1 << 52) + (fraction * float(1 << 52)).cast("long")
    tiny = (a * (2.0 ** 537) * (2.0 ** 537)).cast("long")
    bits = (F.when(a == float("inf"), F.lit(2047 << 52)).when(a == 0, F.lit(0).cast("long"))
            .when(a < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(x < 0, -bits).otherwise(bits)


def _with_image(df: DataFrame, column: str, kind: T.DataType, out: str) -> DataFrame:
    """``df`` with ``out``, the image of a column without NULL. In steps of their own
    columns, so that the logarithm and the power are taken once a row; never NULL,
    or a join on it would test it for NULL below and make it there again."""
    x = F.col(column)
    if isinstance(kind, T.IntegralType):
        return df.withColumn(out, F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    a, near, part = F.col("_a"), F.col("_near"), F.col("_part")
    steps = df.withColumn("_a", F.abs(x)).withColumn("_near", _near(a)).withColumn("_part", _part(a, near))
    return steps.withColumn(out, F.coalesce(_bits(x, a, near, part), F.lit(0).cast("long"))).drop("_a", "_near", "_part")


def _image(c: Column, kind: T.DataType) -> Column:
    return c.cast("long") if isinstance(kind, T.IntegralType) else order_image(c)


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def select_rows(data: DataFrame, groups: Sequence[str], order: Sequence[str], wanted: int,
                position: Callable[[Column, Column], Column], stages: Stages) -> DataFrame:
    """(groups, n, t, at, order columns): the values at position ``at`` (from 0) of
    every group's rows in ``order``, for t from 0 to ``wanted`` - 1, where ``at`` is
    ``position(n, t)`` and n the rows of the group; without a row there, t is absent.

    ``data`` is read once per pass, so it should be a stored table; its order
    columns are doubles without NaN or integers, none NULL. The result reads one
    small table; those of earlier passes are deleted."""
    for c in order:
        if not isinstance(data.schema[c].dataType, (T.IntegralType, T.DoubleType)):
            raise TypeError(f"order column {c!r} is neither a double nor an integer")
    kinds = [data.schema[c].dataType for c in order]
    g, lo, hi = ([f"{p}{i}" for i in range(n)] for p, n in (("g", len(groups)), ("lo", len(order)), ("hi", len(order))))
    rows = data.select(*[F.col(c).alias(a) for c, a in zip(groups, g)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    if not g:
        g, rows = ["g0"], rows.withColumn("g0", F.lit(0))
    ends = [f(f"d.o{i}").alias(n) for i in range(len(order)) for f, n in ((F.min, lo[i]), (F.max, hi[i]))]

    def imaged_rows(column: int) -> DataFrame:
        return _with_image(rows, f"o{column}", kinds[column], "_image").alias("d")

    def counted(source: DataFrame, keys: Sequence[Column], shift: int) -> DataFrame:
        digit = F.shiftright("d._image", shift).alias("cell")
        return source.groupBy(*keys, digit).agg(F.count(F.lit(1)).alias("m"), *ends)

    def placed(counts: DataFrame, keys: Sequence[str], below: Column) -> DataFrame:
        run = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", below + F.coalesce(F.sum("m").over(run), F.lit(0)))

    first = stages.write(counted(imaged_rows(0), [F.col(f"d.{c}") for c in g], SHIFTS[0]), "cells")
    total = first.groupBy(*g).agg(F.sum("m").alias("n")).where("n > 0")
    asked = (total.select(*g, "n", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("t"))
             .withColumn("at", position(F.col("n"), F.col("t")).cast("long")))
    hit = asked.alias("a").join(placed(first, g, F.lit(0).cast("long")).alias("p"),
                                _same("a", "p", g) & (F.col("a.at") >= F.col("p.before")) & (F.col("a.at") < F.col("p.before") + F.col("p.m")))
    keep = [*g, "n", "t", "at"]

    def imaged(found: DataFrame, left_side: str) -> DataFrame:
        """Cuts with the images of their bracket's ends."""
        out = found.select(*[F.col(f"{left_side}.{c}").alias(c) for c in keep], F.col("p.before").alias("below"), *[F.col(f"p.{c}").alias(c) for c in (*lo, *hi)])
        return out.select("*", *[_image(F.col(c), k).alias(f"i{c}") for names in (lo, hi) for c, k in zip(names, kinds)])

    cuts = stages.write(imaged(hit, "a"), "cuts")
    stages.drop(first)
    while (step := _next_digit(cuts, lo, hi)) is not None:
        column, shift = step
        open_here = F.shiftright(f"i{lo[column]}", shift) != F.shiftright(f"i{hi[column]}", shift)
        left, done = cuts.where(open_here), cuts.where(~open_here)
        brackets = left.select(*g, "below", *lo[:column], f"i{lo[column]}").distinct()
        inside = _same("d", "b", g)
        for i in range(column):
            inside = inside & (F.col(f"d.o{i}") == F.col(f"b.{lo[i]}"))
        if shift != SHIFTS[0]:
            inside = inside & (F.shiftright("d._image", shift + BITS) == F.shiftright(f"b.i{lo[column]}", shift + BITS))
        counts = counted(imaged_rows(column).join(brackets.alias("b"), inside), [*[F.col(f"b.{c}") for c in g], F.col("b.below")], shift)
        found = left.alias("l").join(placed(counts, [*g, "below"], F.col("below")).alias("p"),
                                     _same("l", "p", [*g, "below"]) & (F.col("l.at") >= F.col("p.before")) & (F.col("l.at") < F.col("p.before") + F.col("p.m")))
        before, cuts = cuts, stages.write(done.unionByName(imaged(found, "l")), "cuts")
        stages.drop(before)
    return cuts.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], "n", "t", "at", *[F.col(a).alias(c) for c, a in zip(order, lo)])


def _next_digit(cuts: DataFrame, lo: Sequence[str], hi: Sequence[str]) -> tuple[int, int] | None:
    """The first (order column, shift) at which some bracket's ends differ; None when every bracket is one value."""
    steps = [(i, s) for i in range(len(lo)) for s in SHIFTS]
    differ = [F.coalesce(F.max(F.shiftright(f"i{lo[i]}", s) != F.shiftright(f"i{hi[i]}", s)), F.lit(False)).alias(f"d{k}")
              for k, (i, s) in enumerate(steps)]
    row = cuts.agg(*differ).first()
    return next((step for k, step in enumerate(steps) if row[f"d{k}"]), None)


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], names: Sequence[str] | None = None,
                    group_cols: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """One row per group with the linear-interpolation quantile of each prob:
    position p·(n−1) between the values at floor and ceil of it (the rule of
    NumPy's ``percentile`` and DuckDB's ``quantile_cont``).

    NULL and NaN are missing; infinities are values, and a quantile between two
    different values one of which is infinite is that infinity (NaN between the
    two infinities). The needed columns are written once, unless the input is
    ``stored`` already."""
    names = list(names or [f"q{str(p).replace('.', '_')}" for p in probs])
    stages = Stages(df.sparkSession)
    v = F.col(value) if isinstance(value, str) else value
    g = [f"_g{i}" for i in range(len(group_cols))]
    data = (df.select(*[F.col(c).alias(a) for c, a in zip(group_cols, g)], v.cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    if not stored:
        data = stages.write(data, "values")

    def position(n: Column, t: Column) -> Column:
        at = F.get(F.array(*[F.lit(float(p)) for p in probs for _ in range(2)]), t) * (n - 1).cast("double")
        return F.when(t % 2 == 0, F.floor(at)).otherwise(F.ceil(at))

    cuts = select_rows(data, g, ["_v"], 2 * len(probs), position, stages)
    stages.drop(data)
    aggs = [F.max(F.when(F.col("t") == k, F.col("_v"))).alias(f"_{k}") for k in range(2 * len(probs))]
    finals = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        low, high, share = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), at - F.floor(at)
        wide = F.abs(high - low) == float("inf")             # an infinity, or a range beyond the largest double
        between = F.when(wide, low * (1 - share) + high * share).otherwise(low + (high - low) * share)
        finals.append(F.when(low == high, low).otherwise(between).alias(name))
    out = cuts.groupBy(*g).agg(F.max("n").alias("_n"), *aggs)
    result = out.select(*[F.col(a).alias(c) for c, a in zip(group_cols, g)], *finals)
    if not group_cols:
        # a global aggregate gives a row for an empty input, too
        return result.agg(*[F.max(n).alias(n) for n in names])
    return result
