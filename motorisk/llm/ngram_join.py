"""Operator 8: n-gram Jaccard self-join by a prefix tree.

A document's set holds the distinct hashes of its k-word shingles (64 bit, see
``textbytes``). All sets are ordered by one global order: ordinary shingles by
hash, then the *frequent* ones (in a given share of the sets or more) by count.

1. One pass gives every document its set size and set hash (equal sets are one
   node from here on) and counts, per block of rows, shingles that may be
   frequent. Their number is at most (mean set size / share).
2. Every node posts an extended prefix of its ordered set. Two linked nodes
   share at least ``need(size)`` shingles inside these prefixes (the l-prefix
   lemma of adaptive prefix filtering), so nodes that share fewer with all
   others together are done. Postings travel packed, one record per block and
   bucket, after equal sets of a block are merged; frequent shingles need no
   posting, as they are shared by definition. So no bucket holds a hot key.
3. The remaining nodes post their whole sets the same way, which gives the
   number of remaining nodes under every shingle. A node that shares less than
   the least overlap with all others together is done. The others order their
   sets by that number (rarest first), and nodes that share a shingle of their
   basic prefixes form candidate families (connected components over the
   smallest node of every shingle).
4. Inside a family the ordered sets form a trie: sorted sets with the length
   of the prefix common to the one before. Each set walks the trie, reuses the overlap of shared path
   prefixes, and leaves a subtree as soon as its overlap plus what remains of
   the set falls below the least overlap. Sets already known to be connected
   are skipped, which loses no component. A family larger than ``BLOCK`` is cut
   into blocks, one task per pair of blocks.
5. Components of the verified links, mapped back to the documents.

Defined cases: null text and text without words have an empty set and link with
nothing; a text of fewer than k words is one shingle; texts are processed
whole; rows with equal ids are separate rows of one id; an empty table gives an
empty table; other columns are ignored, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Stages, components, likely_members

#: A shingle is frequent when it is in this share of the sets; bounds the broadcast list.
FREQUENT_SHARE = 0.002
#: Most frequent shingles shipped (8 MB); beyond it the commonest are taken. Only the order depends on it.
FREQUENT_MOST = 1_000_000
#: Part of a set by which the posted prefix is longer than the basic one.
EXTENSION = 0.1
#: Sets of a family compared in one task at once; larger families are cut into blocks.
BLOCK = 2048
#: Bytes of text hashed at once, shingles counted or posted at once, postings per bucket.
SLICE_BYTES, BLOCK_SHINGLES, BUCKET_POSTINGS = 512 << 10, 1 << 21, 1 << 19

_HEAVY = np.uint64(1 << 63)


def need_overlap(n: int, percent: int) -> int:
    """Least intersection of a set of ``n`` with any set it links to."""
    return -(-n * percent // 100)


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """(basic prefix, extended prefix) of a set of ``n``."""
    free = n - need_overlap(n, percent)
    return free + 1, min(n, free + 1 + int(EXTENSION * n))


def need_shared(n: int, percent: int) -> int:
    """Shingles of its extended prefix a linked set shares with its partner's:
    the smaller extension of the two counts, and the partner may be smaller."""
    return 1 + int(EXTENSION * need_overlap(n, percent))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def hashed_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the input (text in column 0) with the distinct shingle hashes of every row."""
    for b in batches:
        data, offs = tb.text_buffer(b.column(0))
        for i, j in tb.slices(offs, SLICE_BYTES):
            h, _, first = tb.words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            grams, first = tb.ngrams(h, first, k)
            yield b.slice(i, j - i), tb.distinct_per_row(grams, first)


def set_hash(s: np.ndarray) -> int:
    """Node id of a set: 64 bits of the sum of its mixed shingles and its size."""
    return int(tb.mix(np.asarray([s.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64)) if len(s) else 0


class Order:
    """The global order as sortable 64-bit keys: ordinary shingles keep 63 bits
    of their hash, frequent ones come after them by count."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")        # frequent: hashes, rarest first
        self.hashes = frequent[self.rank]

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = s & ~_HEAVY
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            hit = self.hashes[at] == s
            out[hit] = _HEAVY | self.rank[at[hit]].astype(np.uint64)
        out.sort()
        return out


def _survey(k: int, share: float):
    """Pass 1: rows (0, doc_id, node, size) and (1, shingle, sets of this block that hold it, 0)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def counted(block: dict[int, np.ndarray]) -> pa.RecordBatch | None:
        if len(block) < 3:
            return None
        v = np.concatenate(list(block.values()))
        v.sort()
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.append(start, len(v)))
        hit = n >= max(3, share / 2 * len(block))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(hit.sum(), np.int32)), pa.array(_signed(v[start[hit]])),
                                           pa.array(n[hit]), pa.array(np.zeros(hit.sum(), np.int64))], schema=schema)

    def run(batches):
        block: dict[int, np.ndarray] = {}
        size = 0
        for part, sets in hashed_sets(batches, k):
            nodes = [set_hash(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), part.column(1).cast(pa.int64()),
                 pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], schema=schema)
            for node, s in zip(nodes, sets):
                if len(s) and node not in block:
                    block[node] = s
                    size += len(s)
            if size >= BLOCK_SHINGLES:
                if (out := counted(block)) is not None:
                    yield out
                block, size = {}, 0
        if (out := counted(block)) is not None:
            yield out
    return run


_POSTINGS = "bucket int, keys binary, nodes binary"


def _packed(block: dict[int, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Postings of a block of nodes, one record per bucket: its keys, and the node
    of each; 16 bytes a posting, however many buckets there are."""
    keys = np.concatenate(list(block.values()))
    nodes = np.repeat(np.fromiter(block, np.int64, len(block)), [len(s) for s in block.values()])
    # frequent shingles are shared for certain: dealt by node, not by key
    spread = np.where(keys >= _HEAVY, tb.mix(nodes.view(np.uint64)), tb.mix(keys))
    bucket = (spread % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((keys, bucket))
    keys, nodes, bucket = keys[order], nodes[order], bucket[order]
    ids, start = np.unique(bucket, return_index=True)
    end = np.append(start[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), *(pa.array([x[i:j].tobytes() for i, j in zip(start, end)], pa.binary()) for x in (keys, nodes))],
        names=["bucket", "keys", "nodes"])


def _blocks(sets: Iterator[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs (node, keys) block by block; equal nodes of a block are one."""
    block: dict[int, np.ndarray] = {}
    size = 0
    for node, keys in sets:
        if node not in block:
            block[node] = keys
            size += len(keys)
            if size >= BLOCK_SHINGLES:
                yield _packed(block, buckets)
                block, size = {}, 0
    if block:
        yield _packed(block, buckets)


def _post_prefixes(k: int, percent: int, shared, buckets: int):
    """Pass 2: postings of the extended prefixes."""
    def run(batches):
        order = Order(shared.value)
        yield from _blocks(((set_hash(s), order.keys(s)[:prefix_sizes(len(s), percent)[1]])
                            for _, sets in hashed_sets(batches, k) for s in sets if len(s)), buckets)
    return run


def _post_sets(buckets: int):
    """Pass 3: postings of whole sets (node in column 0, keys in column 1)."""
    def run(batches):
        yield from _blocks(((n, np.frombuffer(s, np.uint64)) for b in batches
                            for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), buckets)
    return run


def _shared_postings(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: postings whose shingle two nodes or more have, with their number."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), dtype=bool)          # the same set from two blocks is one node
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    n = np.diff(np.append(start, len(keys)))
    # a frequent shingle lies in several buckets: more than any number, in the order of its key
    n = np.where(keys >= _HEAVY, np.int64(1) << np.int64(40), np.repeat(n, n))
    return pd.DataFrame({"node": nodes, "key": _signed(keys), "df": n})[n > 1]


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def trie_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (pairs of positions in ``sets``) that span every component of
    "100 * intersection >= percent * union"; the arrays are sorted by the
    global order. See step 4 above."""
    n = len(sets)
    size = np.asarray([len(s) for s in sets])
    # what only one set of the family holds cannot be in an overlap: it leaves the paths
    every = np.concatenate(sets)
    _, dense, count = np.unique(every, return_inverse=True, return_counts=True)
    dense = np.where(count[dense] > 1, dense, -1)
    cut = np.split(dense, np.cumsum(size)[:-1])
    paths = [np.ascontiguousarray(p[p >= 0].astype(">i4")) for p in cut]
    order = sorted(range(n), key=lambda i: paths[i].tobytes())
    paths = [p.astype(np.int32) for p in paths]
    common = [0]                                    # depth at which a path leaves the one before it
    for i, j in zip(order, order[1:]):
        a, b = paths[i], paths[j]
        m = min(len(a), len(b))
        diff = np.flatnonzero(a[:m] != b[:m])
        common.append(int(diff[0]) if len(diff) else m)
    forest, links = _Forest(n), []
    for at, x in enumerate(order):
        px, nx = paths[x], int(size[x])
        least = need_overlap(nx, percent)
        if len(px) < least:
            continue
        depth = 0                                   # of the walked path whose overlaps are known
        overlap = np.zeros(1, dtype=np.int64)       # overlap[d]: shared shingles in the first d of the path
        dead = -1                                   # depth of a subtree given up, or -1
        for pos in range(at + 1, n):
            branch = common[pos]
            if dead >= 0:
                if branch > dead:
                    continue                        # still below the node that was given up
                dead = -1
            depth = min(depth, branch)
            y = order[pos]
            ny = int(size[y])
            if ny * 100 < nx * percent or nx * 100 < ny * percent or forest.root(x) == forest.root(y):
                continue
            rest = paths[y][depth:]
            where = np.searchsorted(px, rest)
            match = px[np.minimum(where, len(px) - 1)] == rest
            grown = overlap[depth] + np.cumsum(match)
            bound = grown + (len(px) - where - match)
            lost = np.flatnonzero(bound < least)
            if len(lost):
                dead = depth + int(lost[0])
                grown = grown[:int(lost[0]) + 1]
            overlap = np.concatenate([overlap[:depth + 1], grown])
            depth = len(overlap) - 1
            if dead < 0:
                inter = int(overlap[-1])
                if 100 * inter >= percent * (nx + ny - inter):
                    links.append((x, y))
                    forest.up[forest.root(y)] = forest.root(x)
    return links


def _family_links(percent: int):
    """Rows sorted by (family, left, right), each a set: one family, or one pair of its blocks, at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = trie_links(sets, percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()),
                                           pa.array([nodes[j] for _, j in pairs], pa.int64())], schema=schema)

    def run(batches):
        key, nodes, sets = None, [], []
        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(b.num_rows):
                now = (cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py())
                if now != key:
                    if len(sets) > 1:
                        yield solve(nodes, sets)
                    key, nodes, sets = now, [], []
                nodes.append(cols[3][i].as_py())
                sets.append(np.frombuffer(cols[4][i].as_py(), np.uint64))
        if len(sets) > 1:
            yield solve(nodes, sets)
    return run


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                       percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): set size and smallest linked id of every row."""
    spark = docs.sparkSession
    st = Stages(spark)
    sc = spark.sparkContext
    narrow = docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("id"))
    survey = st.write(narrow.mapInArrow(_survey(k, FREQUENT_SHARE), "kind int, a long, b long, c long"), "sets")
    rows = survey.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("node"), F.col("c").alias("n"))
    nodes = st.write(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "nodes")
    n_nodes, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # at most total / (share * nodes) shingles can be frequent: the mean set size over the share
    frequent = (survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
                .where(F.col("n") >= max(3, FREQUENT_SHARE * n_nodes)).orderBy(F.desc("n"), "a").limit(FREQUENT_MOST).collect())
    shared = sc.broadcast(np.asarray([r.a for r in reversed(frequent)], dtype=np.int64).view(np.uint64))

    def postings(posted: DataFrame, buckets: int) -> DataFrame:
        return posted.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared_postings, "node long, key long, df long")

    def enough(number: float) -> int:
        return max(sc.defaultParallelism, math.ceil(number / BUCKET_POSTINGS))

    buckets = enough(total * (1 - percent / 100 + EXTENSION) + n_nodes)
    seen = postings(narrow.select("text").mapInArrow(_post_prefixes(k, percent, shared, buckets), _POSTINGS), buckets)
    need = 1 + F.floor(F.lit(EXTENSION) * F.ceil(F.col("n") * percent / 100))
    alive = (seen.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(nodes, "node")
             .where(F.col("m") >= need).select("node", "rep", "n"))
    alive = st.write(alive, "alive")

    def ordered(batches):
        order = Order(shared.value)
        for part, sets in hashed_sets(batches, k):
            want = part.column(1).to_pylist()
            hit = [i for i, s in enumerate(sets) if len(s) and set_hash(s) == want[i]]
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(hit, pa.int64())),
                                              pa.array([order.keys(sets[i]).tobytes() for i in hit], pa.binary())], names=["node", "keys"])

    likely = likely_members(narrow, "id", alive, "rep", alive.count())
    sets = st.write(likely.join(alive, likely["id"] == alive["rep"]).select("text", "node")
                    .mapInArrow(ordered, "node long, keys binary"), "keys")
    buckets = enough(alive.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    full = postings(sets.mapInArrow(_post_sets(buckets), _POSTINGS), buckets).join(alive.select("node", "n"), "node")
    mine = Window.partitionBy("node")
    least = F.ceil(F.col("n") * percent / 100)
    held = (full.withColumn("m", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(mine.orderBy("df", "key")))
            .where((F.col("m") >= least) & (F.col("place") <= F.col("m") - least + 1)).select("node", "key"))
    held = st.write(held, "held")
    hubs = held.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top")
    family = components(held.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    family = st.write(family, "family")
    st.drop(held)

    # families larger than a block: their sets go to every pair of blocks that holds theirs
    parts = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    routed = sets.join(family.join(parts, "component"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = (routed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .where("parts < 3 or own <> other")      # a block meets itself in every pair it is in
              .select("component", F.when(F.col("parts") < 3, 0).otherwise(F.least("own", "other")).alias("i"),
                      F.when(F.col("parts") < 3, 1).otherwise(F.greatest("own", "other")).alias("j"), "node", "keys")
              .dropDuplicates(["component", "i", "j", "node"]))
    links = (placed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
             .mapInArrow(_family_links(percent), "a long, b long"))
    group = components(links)                       # has read the sets when it returns
    st.drop(sets, family, alive)
    linked = group.join(nodes.select("node", "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    per_node = linked.join(least, "component").select("node", "least")
    per_node = nodes.select("node", "rep").join(per_node, "node", "left").select(
        "node", F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(per_node, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out
