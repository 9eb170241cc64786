"""Operator 2: mixing sources to target weights.

Source shares of tokens p are flattened to weights w proportional to
p^exponent. The exponent is bisected (several sections a round, one aggregate
over the source table each) to the largest one at which the weights reach the
target entropy or the smallest source reaches the repetition limit. The
weights, normalised, become token budgets; a budget is realised as whole
seeded permutations (blocks) of the source and a cut one: documents in the order of
a seeded hash while their running token count stays within what is left.

The total budget is the least at which no source gets less than itself, so
every document appears at least once and the mix is reached by repetition.
``budget`` sets another total; then sources can be cut below one block.

The running count is taken over hash buckets first (a small table), then only
inside the bucket that holds the cut, so a source with most of the rows is not
gathered anywhere. The cut is a hash threshold per source, applied to rows
where they lie.

Defined cases: null source is a source of its own; null or empty text has 0
tokens; documents with 0 tokens come once per block; a source without tokens keeps one
block; equal rows have equal hashes and follow the same rule (ties at the cut
stay out together); an empty table stays empty; other columns are kept, and
helper columns avoid their names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, free_name

#: Entropy of the weights aimed at, as a share of the largest possible one, and most passes over a source.
ENTROPY_SHARE, MOST_PASSES = 0.97, 2.0
#: The exponent is a multiple of 1 / STEPS; its range is cut into this many sections a round.
STEPS, SECTIONS = 100_000, 16
#: Leading hex digits of the order hash that make its bucket.
BUCKET_DIGITS = 3
SEED = 11


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\x0b\f\r]+")), F.lit(0)).cast("long")


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))))


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES) -> float:
    """Largest exponent in [0, 1] that reaches the entropy target or the
    repetition limit (0 when neither is reached, 1 when the shares reach it already)."""
    s = sources.where("tokens > 0")
    n, total, low, high = s.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0
    target = entropy_share * math.log(n)

    def reached(grid: list[float]) -> list[bool]:
        """One aggregate: Z and the entropy of the weights for every exponent of the grid."""
        p = F.col("tokens") / F.lit(float(total))
        e = F.col("e")
        got = (s.withColumn("e", F.explode(F.array(*map(F.lit, grid)))).groupBy("e")
               .agg(F.sum(F.pow(p, e)).alias("z"), F.sum(F.pow(p, e) * F.log(p)).alias("l")).collect())
        entropy = {r.e: math.log(r.z) - r.e * r.l / r.z for r in got}
        return [entropy[x] >= target or (high / low) ** (1 - x) >= most_passes for x in grid]

    if reached([1.0])[0]:
        return 1.0
    lo, hi = 0, STEPS                               # in steps; not reached at hi
    while hi - lo > 1:
        grid = sorted({lo + (hi - lo) * i // SECTIONS for i in range(SECTIONS + 1)})
        ok = reached([g / STEPS for g in grid])
        if not any(ok):
            return 0.0
        best = max(i for i, x in enumerate(ok) if x)
        lo, hi = grid[best], grid[min(best + 1, len(grid) - 1)]
    return lo / STEPS


def plan(narrow: DataFrame, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES,
         budget: int | None = None) -> DataFrame:
    """Per source of ``narrow`` (source, tokens, h): tokens, weight, budget,
    whole blocks, and ``cut``: rows with a smaller hash come once more."""
    spark = narrow.sparkSession
    st = Stages(spark)
    sources = st.write(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    e = exponent(sources, entropy_share, most_passes)
    total, high = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"),
                              F.lit(1).cast("long").alias("blocks"), F.lit(None).cast("string").alias("cut"))
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(e))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(power)).first()[0]
    top = (high / total) ** e / z                   # weight of the largest source
    whole = float(budget) if budget is not None else high / top
    planned = (sources.withColumn("weight", power / F.lit(z))
               .withColumn("budget", F.round(F.col("weight") * F.lit(whole)).cast("long"))
               .withColumn("blocks", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long"))
               .withColumn("left", F.when(F.col("tokens") > 0, F.col("budget") - F.col("blocks") * F.col("tokens")).otherwise(F.lit(0))))
    # running tokens over buckets of the hash, then over the one bucket that holds the cut
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    hit = (placed.join(planned.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
           .where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("t")))
           .select("s", "bucket", (F.col("left") - F.col("before")).alias("room")))
    rows = narrow.withColumn("bucket", bucket).alias("n").join(
        hit.alias("h"), F.col("n.source").eqNullSafe(F.col("h.s")) & (F.col("n.bucket") == F.col("h.bucket")))
    # equal hashes (repeated rows) count together
    ties = rows.groupBy("n.source", "n.h").agg(F.sum("n.tokens").alias("t"), F.first("h.room").alias("room"))
    upto = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    over = ties.withColumn("upto", F.sum("t").over(upto)).where("upto > room").groupBy("source").agg(F.min("h").alias("cut"))
    out = planned.join(over, same(planned, over), "left").select(
        planned["source"], "tokens", "weight", "budget", "blocks", "cut")
    return st.write(out, "mix")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED,
        epoch: str = "epoch", order: str = "order_hash", **options) -> DataFrame:
    """``docs`` as often as the mix asks, with ``epoch`` (block number, from 1)
    and ``order_hash`` (place inside its block)."""
    taken = list(docs.columns)
    for c in (epoch, order):
        if c.lower() in {t.lower() for t in taken}:
            raise ValueError(f"column {c!r} exists already; name another output column")
    st = Stages(docs.sparkSession)
    narrow = st.write(docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"),
                                  order_hash(F.col(key), seed).alias("h")), "tokens")
    planned = plan(narrow, **options)
    st.close()
    s, b, c = (free_name([*taken, epoch, order], x) for x in ("mix_source", "mix_blocks", "mix_cut"))
    small = planned.select(F.col("source").alias(s), F.col("blocks").alias(b), F.col("cut").alias(c))
    copies = (F.col(b) + F.when(F.col(order) < F.col(c), 1).otherwise(0)).cast("int")
    return (docs.withColumn(order, order_hash(F.col(key), seed))
            .join(small, F.col(source).eqNullSafe(F.col(s)))
            .withColumn(epoch, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
            .select(*taken, epoch, order))
