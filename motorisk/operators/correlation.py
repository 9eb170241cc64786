"""Pearson and Spearman correlation matrices and feature screening.

Pearson: one aggregate over all column pairs, each pair on its shared
non-null rows. Spearman: average ranks, then Pearson of the ranks, with the
ranks of a pair taken on the pair's shared non-null rows (as pandas does).
A column is ranked once on all its rows; only the partner of a nullable
column is ranked again on the rows where that column is present, and
columns missing on the same rows share that context. All contexts are
ranked in one grouped job over a long (context, column, value) frame, which
gives a table of distinct values with their ranks; the rows look their ranks up
in it, column by column. A table of at most ``MAP_VALUES`` values travels to the
rows, which stay where they are; a longer one costs one shuffle of the narrow
rows, in which values holding more rows than an average partition take no part.

A constant column has no correlation: NULL, where pandas gives NaN (and
Spark's ``corr`` would divide by zero under ANSI mode). All pairs are
computed by one small grouped aggregate over (pair, x, y) rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from . import ordering as O
from .materialize import Stages

ALL = "all"
# Most values of a column whose ranks are broadcast (16 bytes each).
MAP_VALUES = 20_000


def _clean(c: str) -> Column:
    """Numeric value as double with NaN treated as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def pair_correlations(frame: DataFrame, specs) -> DataFrame:
    """Pearson correlation of many (x, y) column pairs in one grouped pass.

    ``specs``: (col_a, col_b, x, y, diagonal) per pair. Each row emits one
    (pair, x, y) row per pair (a fixed fan-out, pipelined into the partial
    aggregate), rows where x or y is missing are skipped, and one
    ``covar_samp``/``var_samp`` aggregate per pair id follows. This keeps the
    aggregate small enough for generated code, where one aggregate with three
    functions per pair does not. Every pair appears in the result; a pair
    without two complete rows, or with a constant side, has NULL; a diagonal
    pair is exactly 1."""
    arr = F.array(*[F.struct(F.lit(i).alias("p"), x.cast("double").alias("x"), y.cast("double").alias("y"))
                    for i, (_, _, x, y, _) in enumerate(specs)])
    stats = (frame.select(F.inline(arr)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy("p").agg(F.covar_samp("x", "y").alias("c"), F.var_samp("x").alias("vx"),
                               F.var_samp("y").alias("vy")))
    labels = frame.sparkSession.createDataFrame(
        [(i, a, b, bool(d)) for i, (a, b, _, _, d) in enumerate(specs)],
        "p int, col_a string, col_b string, diag boolean")
    ok = (F.col("vx") > 0) & (F.col("vy") > 0)
    corr = F.when(ok & F.col("diag"), F.lit(1.0)).when(ok, F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return labels.join(stats, "p", "left").select("col_a", "col_b", corr.alias("corr"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix (col_a, col_b, corr) over every ordered pair."""
    clean = df.select(*[_clean(c).alias(c) for c in columns])
    specs = [(a, b, F.col(a), F.col(b), False) for a, b in combinations(columns, 2)]
    return mirrored(pair_correlations(clean, specs)).unionByName(diagonal_of(clean, columns))


def mirrored(pairs: DataFrame) -> DataFrame:
    """(a, b) rows with their (b, a) twins; the data are passed over once per pair."""
    both = F.array(F.struct("col_a", "col_b"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b")))
    return pairs.select(F.inline(both), "corr")


def diagonal_of(clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 for each column that varies, NULL for the others."""
    return clean.agg(*[F.when(F.var_samp(c) > 0, F.lit(1.0)).alias(c) for c in columns]).unpivot(
        [], list(columns), "col_a", "corr").select("col_a", F.col("col_a").alias("col_b"), "corr")


def _null_masks(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Mask id of every nullable column; columns with the same rows missing
    share one id. Two aggregate passes over the (materialised) input."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    nullable = [c for c in columns if row[c]]
    pairs = list(combinations(nullable, 2))
    same = set()
    if pairs:
        diff = df.agg(*[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"d{i}")
                        for i, (a, b) in enumerate(pairs)]).first()
        same = {p for i, p in enumerate(pairs) if diff[f"d{i}"] == 0}
    mask = {}
    for c in nullable:
        mask[c] = next((mask[a] for a, b in same if b == c and a in mask), c)
    return mask


def spearman_pairs(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]], mirror: bool = False,
                   diagonal: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of each (a, b) pair: (col_a, col_b, corr); with
    ``mirror`` also (b, a), and a diagonal row (1, or NULL when constant) for
    each column in ``diagonal``. One materialised input serves every pass.

    The ranks of a pair are taken on the rows where both are present. A
    column's ranks over its own non-null rows are its ranks in the ``all``
    context, so only a partner of a nullable column needs a restricted
    context: "rows where that mask is present", shared by all columns with
    the same missing rows."""
    cols = sorted({c for p in pairs for c in p} | set(diagonal))
    # a number of its own for every row, fixed by the written table: ``key`` may repeat
    key = "_row"
    stages = Stages(df.sparkSession)
    clean = stages.write(df.select(F.monotonically_increasing_id().alias(key), *[_clean(c).alias(c) for c in cols]), "rank-input")
    mask = _null_masks(clean, cols)

    def ctx(col: str, partner: str) -> str:
        m = mask.get(partner)
        return ALL if m is None or mask.get(col) == m else m

    need: dict[str, set] = {}
    for a, b in pairs:
        need.setdefault(ctx(a, b), set()).add(a)
        need.setdefault(ctx(b, a), set()).add(b)
    parts = []
    for name, needed in need.items():
        frame = clean if name == ALL else clean.where(F.col(name).isNotNull())
        needed = sorted(needed)
        parts.append(frame.select(*needed).unpivot([], needed, "column", "value").withColumn("ctx", F.lit(name)))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    values = stages.write(O.value_positions(long, "value", ["ctx", "column"]).select(
        "ctx", "column", "v", "w", (F.col("before") + (F.col("w") + 1) / 2.0).alias("rank")), "ranks")
    sizes = {(r.ctx, r.column): r for r in values.groupBy("ctx", "column").agg(F.count(F.lit(1)).alias("values"), F.sum("w").alias("rows")).collect()}
    slots = {(n, c): f"r{i}" for i, (n, c) in enumerate(sorted((n, c) for n, cs in need.items() for c in cs))}
    wide = clean
    for (name, column), slot in slots.items():
        wide = _with_rank(wide, column, slot, values.where((F.col("ctx") == name) & (F.col("column") == column)), sizes.get((name, column)), key)
    col_of = {k: F.col(sl) for k, sl in slots.items()}
    specs = []
    for a, b in pairs:
        x, y = col_of[(ctx(a, b), a)], col_of[(ctx(b, a), b)]
        specs.append((a, b, x, y, False))
    out = pair_correlations(wide, specs)
    if mirror:
        out = mirrored(out)
    return out.unionByName(diagonal_of(clean, diagonal)) if diagonal else out


def _with_rank(wide: DataFrame, column: str, slot: str, values: DataFrame, size, key: str) -> DataFrame:
    """Rows with the rank of their value in ``column`` as ``slot``; NULL for values that are not in the table."""
    table = values.select(F.col("v").alias("_v"), F.col("rank").alias(slot), "w")
    if size is None:
        return wide.withColumn(slot, F.lit(None).cast("double"))
    if size["values"] <= MAP_VALUES:
        return wide.join(F.broadcast(table.drop("w")), F.col(column) == F.col("_v"), "left").drop("_v")
    n = shuffle_partitions(wide.sparkSession)
    # fewer values than partitions hold more rows than an average partition
    hot = table.where(F.col("w") > size["rows"] / n).select(F.col("_v").alias("_hot"), F.col(slot).alias("_hot_rank"))
    cold = table.where(F.col("w") <= size["rows"] / n).drop("w").withColumn("_place", F.lit(0).cast("long"))
    marked = wide.join(F.broadcast(hot), F.col(column) == F.col("_hot"), "left")
    # rows that need no look-up are dealt evenly: their place matches nothing
    place = F.when(F.col(column).isNull() | F.col("_hot").isNotNull(), F.col(key) + 1).otherwise(F.lit(0))
    marked = marked.withColumns({"_place": place, "_key": F.coalesce(F.col(column), F.lit(0.0))})
    found = marked.join(cold, (F.col("_key") == F.col("_v")) & (marked["_place"] == cold["_place"]), "left")
    return found.select(*wide.columns, F.coalesce("_hot_rank", slot).alias(slot))


def spearman_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Long Spearman matrix over every ordered pair (diagonal 1, or NULL
    for a constant column)."""
    return spearman_pairs(df, key, list(combinations(columns, 2)), mirror=True, diagonal=columns)


def feature_screen(df: DataFrame, key: str, target: str, features: Sequence[str]) -> DataFrame:
    """Spearman correlation of each feature with the target, sorted
    descending (the target itself first, as in the reference's table)."""
    res = spearman_pairs(df, key, [(target, f) for f in features], diagonal=[target])
    out = res.select(F.when(F.col("col_a") == F.col("col_b"), F.col("col_a")).otherwise(F.col("col_b"))
                     .alias("feature"), "corr")
    return out.orderBy(F.desc_nulls_last("corr"), "feature")
