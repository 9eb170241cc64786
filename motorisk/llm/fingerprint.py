"""Operator 10: document fingerprints as invertible Bloom lookup sketches,
in DataFrame functions only.

A document's paragraphs are its lines that are not empty; a long line is cut
into pieces of ``LEAST`` bytes or more, each up to the first place where the two
last bytes lie in fixed classes, so a change alters the pieces around it only
(one pattern over the bytes; scripts without blanks are cut as well). Paragraphs,
each counted once, have 64-bit digests. A sketch has ``TABLES`` tables of
``WIDTH`` cells; every digest falls into one cell of each table, and a cell keeps
the number, the xor of the digests and the xor of their check hashes. Subtracting
two sketches leaves the digests that only one side has; peeling takes pure cells
(number 1 or -1, check matching) until none is left, which recovers the differing
digests. When cells remain, the pair is tried again with a larger sketch: the
digests are dealt by hash over so many sketches of the same size that each gets
about ``LOAD``, and those that still cannot be decoded over four times as many,
with new hashes, until all are recovered.

Likeness of two versions = 1 - recovered differences / digests of both
(two documents without paragraphs: 1). The fingerprint is the first sketch as
text.

The texts are shuffled once, and nothing else is; what is stored are digests: rows go to buckets of the id
(bounds from approximate quantiles; only the bounds and one id per bucket reach
the driver), a copy of each bucket's first row closes the bucket before it, and
digests, sketches and peeling follow where the next document is known, row by row.

Defined cases: null text is empty; an empty text has no paragraphs; rows
without id come last; rows with equal ids are ordered by the hash of the text;
a single row is followed by itself; an empty table stays empty; other columns
are ignored, whatever their names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, long_array, shuffle_partitions

TABLES, WIDTH = 3, 12
CELLS = TABLES * WIDTH
#: Most rounds of peeling a sketch of this size can need; digests of both sides that one sketch is given on a retry.
ROUNDS, LOAD = 10, 12
_CHECK, _DEAL = 101, 211
#: Rounds of dealing a pair anew; the chance that one is left after them is below 1e-40.
DEALS = 14
#: Bytes of a piece of a long line: least, and most where no place to cut comes.
LEAST, MOST = 64, 1024
_CELL = "struct<n:int,d:bigint,c:bigint>"
_PART = "struct<x:array<bigint>,y:array<bigint>>"
_FIRST = -(1 << 63)


def _byte_class(factor: int) -> str:
    """A quarter of all byte values but the line end, scattered by a multiplication, as a pattern's class."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b != 10 and b * factor % 256 < 64) + "]"


#: A piece: from ``LEAST`` bytes on, up to two bytes in the classes; else what is left of the line.
PIECE = rf"[^\n]{{{LEAST},{MOST}}}?(?<={_byte_class(37)}{_byte_class(101)})|[^\n]{{1,{MOST}}}"


def paragraphs(text: Column) -> Column:
    """Distinct paragraph digests of a text that is not null."""
    # one character for each byte, so the classes hold for every script
    as_bytes = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.array_distinct(F.transform(F.regexp_extract_all(as_bytes, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(d: Column, table: Column | int, level: Column | int = 0) -> Column:
    t, lv = (F.lit(x) if isinstance(x, int) else x for x in (table, level))
    return t * WIDTH + F.pmod(F.xxhash64(d, t + lv * TABLES), F.lit(WIDTH)).cast("int")


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(_CHECK))


def _struct(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), d.alias("d"), c.alias("c"))


def _placed(d: Column, level: Column | int) -> Column:
    """A digest with its check hash and its cell of each table."""
    return F.struct(d.alias("d"), _check(d).alias("c"), *(_cell(d, t, level).alias(f"a{t}") for t in range(TABLES)))


def sketch(digests: Column, level: Column | int = 0) -> Column:
    """The cells of a set of digests; ``level`` chooses the hashes."""
    nothing = _struct(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def table(entries: Column, t: int) -> Column:
        return F.transform(F.sequence(F.lit(t * WIDTH), F.lit((t + 1) * WIDTH - 1)), lambda i: F.aggregate(
            F.filter(entries, lambda e: e[f"a{t}"] == i), nothing,
            lambda a, e: _struct(a["n"] + 1, a["d"].bitwiseXOR(e["d"]), a["c"].bitwiseXOR(e["c"]))))
    # one-element array: hashes are computed once for a digest
    return F.transform(F.array(F.transform(digests, lambda d: _placed(d, level))),
                       lambda entries: F.concat(*(table(entries, t) for t in range(TABLES))))[0]


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _struct(x["n"] - y["n"], x["d"].bitwiseXOR(y["d"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, level: Column | int = 0) -> Column:
    """struct(cells left, recovered struct(d, n): n is 1 for the first side, -1 for the second)."""
    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), F.array().cast("array<struct<d:bigint,n:int>>").alias("got"),
                     F.lit(True).alias("on"))

    def pure(state: Column) -> Column:
        hit = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["d"]) == c["c"]))
        return F.array_distinct(F.transform(hit, lambda c: F.struct(c["d"].alias("d"), c["n"].alias("n"))))

    def without(cells: Column, got: Column) -> Column:
        def cell(c: Column, i: Column, gone: Column) -> Column:
            mine = F.filter(gone, lambda g: (g["p"]["a0"] == i) | (g["p"]["a1"] == i) | (g["p"]["a2"] == i))
            return F.aggregate(mine, c, lambda a, g: _struct(
                a["n"] - g["n"], a["d"].bitwiseXOR(g["p"]["d"]), a["c"].bitwiseXOR(g["p"]["c"])))
        marked = F.transform(got, lambda g: F.struct(g["n"].alias("n"), _placed(g["d"], level).alias("p")))
        return F.transform(F.array(marked), lambda gone: F.transform(cells, lambda c, i: cell(c, i, gone)))[0]

    def step(state: Column, _) -> Column:
        # one-element array: the pure cells are found once a round
        nxt = F.transform(F.array(pure(state)), lambda p: F.when(F.size(p) == 0, F.struct(
            state["cells"].alias("cells"), state["got"].alias("got"), F.lit(False).alias("on"))).otherwise(F.struct(
                without(state["cells"], p).alias("cells"), F.concat(state["got"], p).alias("got"), F.lit(True).alias("on"))))[0]
        return F.when(state["on"], nxt).otherwise(state)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _peeled(a: Column, b: Column, level: Column | int = 0) -> Column:
    """(number recovered, whether all cells are empty) of two digest sets' sketches."""
    return F.transform(F.array(peel(subtract(a, b), level)), lambda s: F.struct(
        F.size(s["got"]).alias("n"), (~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["d"] != 0) | (c["c"] != 0))).alias("all")))[0]


def _dealt(part: Column, level: Column, side: Column) -> Column:
    """``part`` (x, y) cut by hash into side^2 parts: first by the high half of the number, then by the low one."""
    count = F.sequence(F.lit(0).cast("long"), side - 1)

    def numbered(digests: Column) -> Column:
        def halves(d: Column) -> Column:
            h = F.shiftrightunsigned(F.xxhash64(d, level + _DEAL), 1)
            return F.struct(d.alias("d"), (h % side).alias("hi"), (F.shiftrightunsigned(h, 24) % side).alias("lo"))
        return F.transform(digests, halves)

    def cut(p: Column, mine) -> Column:
        return F.struct(F.filter(p["x"], mine).alias("x"), F.filter(p["y"], mine).alias("y"))
    bare = lambda side_: F.transform(side_, lambda e: e["d"])
    marked = F.struct(numbered(part["x"]).alias("x"), numbered(part["y"]).alias("y"))
    rough = F.transform(F.array(marked), lambda m: F.transform(count, lambda i: cut(m, lambda e: e["hi"] == i)))[0]
    fine = F.flatten(F.transform(rough, lambda r: F.transform(count, lambda j: cut(r, lambda e: e["lo"] == j))))
    return F.transform(fine, lambda p: F.struct(bare(p["x"]).alias("x"), bare(p["y"]).alias("y")))


def differences(x: Column, y: Column) -> Column:
    """Number of digests that only one of two sets has, recovered from larger and larger sketches."""
    whole = F.struct(x.alias("x"), y.alias("y"))
    side = F.ceil(F.sqrt(F.greatest(F.lit(1.0), (F.size(x) + F.size(y)) / F.lit(LOAD)))).cast("long")
    start = F.struct(_dealt(whole, F.lit(1), side).cast(f"array<{_PART}>").alias("parts"), F.lit(0).alias("n"))

    def step(state: Column, level: Column) -> Column:
        tried = F.transform(state["parts"], lambda p: F.struct(p.alias("p"), _peeled(sketch(p["x"], level), sketch(p["y"], level), level).alias("r")))

        def sorted_out(t: Column) -> Column:
            more = F.aggregate(F.filter(t, lambda e: e["r"]["all"]), F.lit(0), lambda n, e: n + e["r"]["n"])
            again = F.flatten(F.transform(F.filter(t, lambda e: ~e["r"]["all"]), lambda e: _dealt(e["p"], level + 1, F.lit(2).cast("long"))))
            return F.struct(again.cast(f"array<{_PART}>").alias("parts"), (state["n"] + more).alias("n"))
        # one-element array: the parts are tried once a round
        return F.when(F.size(state["parts"]) == 0, state).otherwise(F.transform(F.array(tried), sorted_out)[0])

    done = F.aggregate(F.sequence(F.lit(1), F.lit(DEALS)), start, step)
    return F.transform(F.array(done), lambda s: F.when(F.size(s["parts"]) == 0, s["n"]).otherwise(
        F.raise_error(F.lit("digests were left after all rounds of dealing")).cast("int")))[0]


def recovered_differences(pairs: DataFrame, a: str, b: str, keys: list[str], st: Stages) -> DataFrame:
    """(keys, d): differing digests of the arrays ``a`` and ``b`` of every row that holds any."""
    return pairs.where(F.size(a) + F.size(b) > 0).select(*keys, differences(F.col(a), F.col(b)).alias("d"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``key``, by two levels of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    fine = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(long_array([f[0] for f in fine]), lambda x: x < key))
    part = F.slice(long_array(bounds), F.greatest(F.lit(1), (coarse - 1) * step + 1), F.lit(step))
    below = F.size(F.filter(part, lambda x: x < key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below)


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the named columns of the next row in descending (key, tie)
    order, prefixed ``next_``; the first row follows the last. Columns of
    ``derived`` (in this order, each from those before) are made behind the shuffle."""
    n = shuffle_partitions(rows.sparkSession)
    probs = [i / n for i in range(1, n)]
    got = rows.agg(F.percentile_approx(key, probs, 10 * n).alias("q")).first().q if probs else []
    bounds = sorted(set(got or []))
    placed = rows.withColumn("_b", _bucket(F.col(key), bounds))
    heads = sorted(placed.groupBy("_b").agg(F.max(key).alias("k")).collect(), reverse=True)     # one row per bucket
    # the first row of a bucket (and its ties) also closes the bucket before it
    before = {h.k: heads[i - 1]["_b"] for i, h in enumerate(heads)}
    at = F.array_position(long_array(list(before)), F.col(key)).cast("int")
    placed = placed.withColumn("_to", F.get(long_array(list(before.values())), at - 1).cast("int"))
    own, copy = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))
    both = placed.withColumn("_place", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    both = both.withColumns({"_b": F.col("_place.b"), "_g": F.col("_place.g")}).drop("_place", "_to").repartition("_b")
    for name, value in (derived or {}).items():
        both = both.withColumn(name, value)
    w = Window.partitionBy("_b").orderBy("_g", F.desc(key), F.desc(tie))
    nxt = F.lead(F.struct(*columns)).over(w)
    return (both.withColumn("_next", nxt).where("_g = 0")
            .select(*rows.columns, *(derived or {}), *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row; the edited text has its last half
    replaced by the beginning of the next document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = (docs.select(F.col(key).cast("long").alias("id"), body.alias("text"))
            .withColumns({"k": F.coalesce("id", F.lit(_FIRST)), "tie": F.xxhash64("text")}))
    paired = with_next(rows, "k", "tie", ["text", "own", "cells"], {"own": paragraphs(F.col("text")), "cells": sketch(F.col("own"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = paired.select("id", n.cast("long").alias("n_chars"), "own", "cells", "next_own", "next_cells", edited.alias("edited"))
    both = both.withColumns({"edited_sha256": F.sha2("edited", 256), "new": paragraphs(F.col("edited"))}).drop("edited")
    both = both.withColumn("new_cells", sketch(F.col("new")))
    both = both.withColumns({"p0": _peeled(F.col("cells"), F.col("new_cells")), "p1": _peeled(F.col("cells"), F.col("next_cells"))})

    def likeness(p: str, other: str) -> Column:
        both = F.size("own") + F.size(other)
        d = F.when(F.col(f"{p}.all"), F.col(f"{p}.n")).otherwise(differences(F.col("own"), F.col(other)))
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - d / both).cast("double")

    def printed(cells: Column) -> Column:
        return F.array_join(F.transform(cells, lambda c: F.concat_ws(
            ".", c["n"].cast("string"), F.lower(F.hex(c["d"])), F.lower(F.hex(c["c"])))), " ")
    # the digests are shorter than the sketches, which are made again to be printed
    told = Stages(docs.sparkSession).write(both.select("id", "n_chars", "edited_sha256", "own", "new", likeness("p0", "new").alias("near_edited"),
                                                       likeness("p1", "next_own").alias("near_next")), "versions")
    return told.select(F.col("id").alias(key), "n_chars", "edited_sha256", printed(sketch(F.col("own"))).alias("fingerprint"),
                       printed(sketch(F.col("new"))).alias("edited_fingerprint"), "near_edited", "near_next")
