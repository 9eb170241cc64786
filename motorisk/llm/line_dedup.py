"""Operator 3: line dedup, an exact set-similarity join in DataFrame functions only.

A line's set holds its distinct 5-word shingles (words between ASCII white
space, lower case; 64-bit hashes). With ``short``, as in the registered queries,
a line of one to four words (a line of an unspaced script, too) has one shingle,
its whole word sequence. A line goes when an earlier line, in the order of
(document id, line number), has a set with Jaccard similarity of ``SIMILARITY``
or more; whether that earlier line stays itself does not matter, so the result
does not depend on any order of work.

1. Lines of equal words: only the first can stay, the others need no
   comparison.
2. Elimination: in a fixed order of all shingles, two similar sets share
   several shingles of their extended prefixes (the l-prefix lemma: prefixes
   longer by l - 1 share l). Lines that share fewer with all others match
   nothing. Shingles whose first word hashes low come first in that order, so the prefix
   of a longer line is found without hashing its other shingles. A shingle whose
   smallest and largest line (combined before the shuffle, so a frequent line
   costs its shingles one row per task) are the same is shared with none: such
   shingles are counted per line, and nothing is joined.
3. The others are joined: their shingles are ordered by rarity (counts of
   ``RARITY_CELLS`` hash cells over all these lines, a table of fixed size, then
   the hash), and prefixes joined with length and positional filters. First
   each line meets the earliest line under each shingle, which settles groups
   of near copies without pairing them all; lines left meet the other earlier
   ones. Candidates are verified on whole sets.

Defined cases: null text stays null, empty text stays empty; lines without
words always stay, and without ``short`` those of fewer than five words; a text that loses all lines
becomes empty; rows with equal ids count as one document, so the same line at
the same place of a repeated row is no later match; rows without id are left
alone; an empty table stays empty; other columns are kept, and helper columns
avoid their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_index
from .common import Stages, free_name, likely_members, long_array

SIMILARITY_PERCENT, WORDS = 80, 5
#: White space of ASCII, as in a pattern's class.
BLANKS = r"\x20\x09-\x0D"
OTHER_BLANKS = r"[\x09-\x0D]"
RARITY_CELLS = 1 << 16
#: Shingles by which the prefix of the elimination is longer than the basic one; fewer for sets of up to 6.
EXTENSION = 2
#: Lines of more shingles than ``WHOLE`` hash first those whose first word hashes into the lowest ``EARLY`` of the range.
WHOLE, EARLY = 24, 0.4


def _words(line: str) -> Column:
    """The words of a line, lower case."""
    low = F.lower(line)
    # one fixed character is cut at without a pattern
    return F.array_remove(F.when(low.rlike(OTHER_BLANKS), F.split(low, f"[{BLANKS}]")).otherwise(F.split(low, " ")), "")


def _enough(line: str, short: bool) -> Column:
    """Whether a line has a set; by the line itself, for a condition on the set
    would be moved below and make it there again."""
    return F.col(line).rlike(f"[^{BLANKS}]" if short else f"(?:[^{BLANKS}]+[{BLANKS}]+){{{WORDS - 1}}}[^{BLANKS}]")


def with_shingles(df: DataFrame, line: str, out: str, short: bool = False) -> DataFrame:
    """The rows of ``df`` whose line has words (without ``short``: at least
    ``WORDS``), with ``out``, its sorted distinct shingle hashes; with ``short`` the
    words of a line of fewer than ``WORDS`` are one shingle. In steps of their own
    columns, so that the words are hashed once and generated code makes the sets."""
    words, grams = (free_name(df.columns, x) for x in ("line_words", "line_grams"))
    h = F.col(words)

    def grams_of(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(a) - F.lit(WORDS)))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(WORDS))))

    # the hashes are a variable of an outer function, so the inner one need not take them from the row each time
    gram = F.get(F.transform(F.array(h), grams_of), 0)
    df = df.where(_enough(line, short)).withColumn(words, F.transform(_words(line), lambda w: F.xxhash64(w)))
    df = df.withColumn(grams, F.when(F.size(h) >= WORDS, gram).otherwise(F.array(F.xxhash64(h))))
    return df.withColumn(out, F.sort_array(F.array_distinct(grams))).drop(words, grams)


def extension(n: Column) -> Column:
    return F.least(F.lit(EXTENSION), F.greatest(F.lit(0), n - F.lit(WORDS))).cast("int")


def with_prefix(df: DataFrame, line: str, percent: int, short: bool = False) -> DataFrame:
    """The rows of ``df`` whose line has a set, with ``sid``, a hash of its words,
    ``keys``, the hashes of its extended prefix, and ``spare``: a line of which more
    keys are shared with no other line is similar to none.

    The order of shingles is that of hashes made negative where the first word
    hashes low. A line has at most as many shingles as places for them; prefixes
    are as long as that number asks, which is never too short. ``spare`` goes by
    the shingles known to be distinct."""
    words, heads, early, whole = (free_name(df.columns, x) for x in ("line_words", "line_heads", "line_early", "line_whole"))
    w = F.col(words)
    places = F.greatest(F.lit(1), F.size(w) - F.lit(WORDS - 1))
    length = prefix_size(places, percent) + extension(places)
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    bound = F.lit(round((EARLY - 0.5) * (1 << 64)))
    none = F.array().cast("array<bigint>")

    def hashes(rest) -> Column:
        """Of all places; ``rest`` gives those that do not come first their value."""
        def of(a: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                gram = F.xxhash64(x, *(F.get(a, i + k) for k in range(1, WORDS)))
                return F.when(x < bound, gram.bitwiseOR(least)).otherwise(rest(gram))
            return F.transform(heads, one)
        return F.sort_array(F.array_distinct(F.get(F.transform(F.array(w), of), 0)))

    first = F.size(early) > length                  # the last of them stands for all that come later
    df = df.where(_enough(line, short)).withColumn(words, F.transform(_words(line), lambda x: F.xxhash64(x)))
    # the first words of all places, cut outside the functions, where generated code does it
    df = df.withColumn(heads, F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - F.lit(WORDS - 1))))
    df = df.withColumn(early, F.when(F.size(w) > WHOLE + WORDS - 1, hashes(lambda g: most)).otherwise(none))
    df = df.withColumn(whole, F.when(first, none).when(F.size(w) < WORDS, F.array(F.xxhash64(w)))
                       .otherwise(hashes(lambda g: g.bitwiseAND(most))))
    df = (df.withColumn("keys", F.slice(F.when(first, F.col(early)).otherwise(F.col(whole)), F.lit(1), length))
          .withColumn("sid", F.xxhash64(words)))
    # a partner may be smaller, and the smaller extension counts
    known = F.when(first, F.size(early) - F.lit(1)).otherwise(F.size(whole))
    need = F.lit(1) + extension(F.ceil(known * percent / 100))
    return df.withColumn("spare", (F.size("keys") - need).cast("int")).drop(words, heads, early, whole)


def prefix_size(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return (docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
            .select("id", F.posexplode(F.split("text", "\n")).alias("no", "line")))


def removed_lines(docs: DataFrame, st: Stages, key: str = "doc_id", text: str = "text",
                  percent: int = SIMILARITY_PERCENT, short: bool = False) -> DataFrame:
    """(id, no, lh): place and hash of every line that goes."""
    sets = (with_prefix(_lines(docs, key, text), "line", percent, short)
            .select("id", "no", F.xxhash64("line").alias("lh"), "sid", "spare", "keys"))
    lines = st.write(sets, "lines")
    firsts = st.write(lines.groupBy("sid").agg(F.min(F.struct("id", "no", "lh")).alias("f"), F.first("spare").alias("spare"))
                      .select("sid", "f.id", "f.no", "f.lh", "spare"), "firsts")
    # elimination may take shingles for shared that are not, so 48 bits of them do
    posted = lines.select("sid", F.explode("keys").alias("key")).withColumn("key", F.col("key").bitwiseAND(F.lit((1 << 48) - 1)))
    alone = (posted.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
             .where("lo = hi").select(F.col("lo").alias("sid")).repartition("sid").groupBy("sid").agg(F.count(F.lit(1)).alias("own")))
    left = firsts.join(alone, "sid", "left").where(F.coalesce("own", F.lit(0)) <= F.col("spare"))
    ranked = st.write(row_index(left.select("sid", "id", "no", "lh"), ["id", "no", "sid"], "r"), "ranked")

    # whole sets of the lines left, from the text
    wanted = ranked.groupBy("id").agg(F.collect_list(F.struct("no", "lh", "r")).alias("want"))
    bodies = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = st.write(wanted, "wanted")
    texts = likely_members(bodies, "id", wanted, "id", wanted.count()).join(wanted.hint("shuffle_hash"), "id")
    asked = (texts.withColumn("all", F.split("text", "\n")).select("id", "all", F.explode("want").alias("w"))
             .select("id", "w.lh", "w.r", F.get("all", F.col("w.no")).alias("line")).where("xxhash64(line) = lh"))
    # a line of a repeated row once: rows of an id are together after the join, so no set is shuffled for it
    picked = with_shingles(asked.dropDuplicates(["id", "r"]), "line", "a", short).select("r", "a")
    picked = st.write(picked, "sets")

    # rarity: counts of hash cells, a fixed number of rows
    cell = lambda x: F.pmod(x, F.lit(RARITY_CELLS))
    counts = (picked.select(F.explode("a").alias("x")).groupBy(cell(F.col("x")).alias("cell"))
              .agg(F.count(F.lit(1)).alias("c")).collect())
    rank = [0] * RARITY_CELLS
    for i, row in enumerate(sorted(counts, key=lambda r: (r.c, r.cell))):
        rank[row.cell] = i
    ranks = long_array(rank)
    low = F.lit((1 << 46) - 1)
    ordered = picked.select("r", F.size("a").alias("n"), F.sort_array(F.transform(
        "a", lambda x: F.shiftleft(F.get(ranks, cell(x).cast("int")), 46).bitwiseOR(x.bitwiseAND(low)))).alias("o"))
    ordered = st.write(ordered, "ordered")
    st.drop(wanted, picked)
    prefix = ordered.select("r", "n", F.posexplode(F.slice("o", F.lit(1), prefix_size(F.col("n"), percent))).alias("pos", "key"))
    hubs = prefix.groupBy("key").agg(F.min("r").alias("hub"), F.max("r").alias("top")).where("hub < top").select("key", "hub")
    prefix = st.write(prefix.join(hubs, "key"), "prefix")

    def pairs(left: DataFrame, right: DataFrame, how: Column) -> DataFrame:
        """Candidates under one shingle, past the length and positional filters."""
        a, b = left.alias("a"), right.alias("b")
        na, nb = F.col("a.n"), F.col("b.n")
        least = F.ceil((na + nb) * percent / (100 + percent))
        # at the first shingle a pair shares nothing before it is shared: this one and all after it must do
        later = F.least(na - F.col("a.pos"), nb - F.col("b.pos"))
        return (a.join(b, (F.col("a.key") == F.col("b.key")) & how & (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
                       & (later >= least))
                .select(F.col("a.r").alias("r"), F.col("b.r").alias("s")).distinct())

    def verified(cand: DataFrame) -> DataFrame:
        """Lines of ``cand`` with a partner that is similar enough."""
        both = (cand.join(ordered.select("r", F.col("o").alias("x")), "r")
                .join(ordered.select(F.col("r").alias("s"), F.col("o").alias("y")), "s"))
        inter = F.size(F.array_intersect("x", "y"))
        return both.where(inter * 100 >= percent * (F.size("x") + F.size("y") - inter)).select("r").distinct()

    near_first = verified(pairs(prefix.where("r <> hub"), prefix.where("r = hub"), F.lit(True)))
    near_first = st.write(near_first, "matched")
    open_lines = prefix.join(near_first, "r", "left_anti")
    rest = verified(pairs(open_lines.where("r <> hub"), prefix.where("r <> hub"), F.col("b.r") < F.col("a.r")))
    matched = near_first.unionByName(st.write(rest, "matched")).distinct()
    st.drop(prefix, ordered)
    gone = matched.join(ranked, "r").select("sid", F.lit(True).alias("gone"))
    at = firsts.select("sid", F.col("id").alias("fid"), F.col("no").alias("fno"), F.col("lh").alias("flh"))
    later = (lines.select("id", "no", "lh", "sid").join(at, "sid").join(gone, "sid", "left")
             .where("gone or id <> fid or no <> fno or lh <> flh"))
    return later.select("id", "no", "lh")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None,
                percent: int = SIMILARITY_PERCENT, short: bool = False) -> DataFrame:
    """``docs`` without the lines that go; with ``removed``, a column of that
    name counts them. ``short``: lines of fewer than ``WORDS`` words take part."""
    if removed and removed.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {removed!r} exists already; name another output column")
    st = Stages(docs.sparkSession)
    gone = removed_lines(docs, st, key, text, percent, short)
    k, g = (free_name(docs.columns, x) for x in ("line_doc", "line_gone"))
    per_doc = gone.groupBy(F.col("id").alias(k)).agg(F.collect_set(F.struct("no", "lh")).alias(g))
    # one row a document in the hashed tables, here and for the texts above: no text is sorted
    joined = docs.join(per_doc.hint("shuffle_hash"), F.col(key).cast("long") == F.col(k), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(g), F.struct(i.alias("no"), F.xxhash64(x).alias("lh")))), "\n")
    out = [F.when(F.col(g).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns]
    if removed:
        out.append(F.coalesce(F.size(g), F.lit(0)).alias(removed))
    return joined.select(*out)
