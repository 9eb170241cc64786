"""Gradient boosting on binned histograms (M6, M7).

Rows are binned once: each feature gets at most ``maxBins`` bins whose edges lie
between its values (all of them when there are few, else at even positions of their order), a
missing value has a bin of its own above the others. Rows alike in all bins have
the same score in every round, so they are kept as one row with their number and
the sum of their labels. Rows lie in blocks of NumPy arrays, one byte per bin where
that is enough, so a pass over them is one short Spark job without a query plan. A
tree is grown from sums of gradient, hessian and rows per (node, feature, bin):

* One pass over the rows measures every node that is open: each task routes its
  rows down the tree found so far and counts them into the nodes' histograms, which
  Spark adds up; of two siblings only the one with fewer rows is measured, the
  other is its parent less the sibling.
* Once every open node has at most ``LOCAL_ROWS`` rows, each is finished by one task,
  which grows the same subtree from that node's rows, so deep and small branches
  cost no passes. No subtree is grown beyond the leaves that are left to the tree, or
  below the least gain that a split of it can have.
* ``growth="leaf"`` (M6) splits the leaf of greatest gain until ``maxLeaves``
  leaves. Which leaf comes next depends on gains that are known only after a
  pass, so all leaves that may still be split are opened in a pass, and the order
  is replayed on what is known; leaves opened in vain are dropped in the end. A
  tree takes at most as many passes as it is deep, not one per leaf.
* ``growth="depth"`` (M7) splits every leaf above ``maxDepth`` whose gain is
  positive.

With gradient sum G and hessian sum H a leaf's value is -G / (H + lambda), and a
split gains (GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)) / 2 -
gamma; it must be positive, and both sides need ``minInstances`` rows and a
hessian of ``minChildWeight``. Equal gains go to the first feature and bin.
``loss`` is ``squared`` (hessian 1) or ``poisson`` (log link: gradient mu - y,
hessian mu).

Scale: what reaches the driver per pass is a row per (open node, feature, bin) and
partition; where that is much, tasks add it up first. The trees are small lists. Rows
are shuffled once, when equal ones are joined, and again only when nodes are finished
in tasks; a shuffle's files go with the pass. Scores move with every tree: the blocks
of a round are persisted in memory and on disk until the next, and every
``checkpointEvery`` rounds they are written to the checkpoint folder, so a lost
executor replays a few trees at most, and the file before is deleted.

Early stopping is off unless asked for, at every size. With it, a share of the
rows chosen by a seeded hash of the row is held out, so another partition layout
holds out the same rows, and the fit stops when the held-out loss has not improved
by more than ``tol`` over the last ``nIterNoChange`` rounds."""

from __future__ import annotations

import heapq
import json
import math
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import Stages
from ..session import ensure_checkpoint_dir

# Most stored rows, and bins of rows, of a node whose subtree one task grows.
LOCAL_ROWS, LOCAL_BINS = 1 << 20, 1 << 23
# Rows of a block, and rows that make another partition.
BLOCK_ROWS, PARTITION_ROWS = 1 << 17, 1 << 20
# Most numbers of a pass that reach the driver unadded.
DRIVER_NUMBERS = 1 << 22
# Cells into which a pass of the search for bin edges cuts a feature's open brackets.
EDGE_CELLS = 1 << 14

# Tasks get this module's functions and classes with the task: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Node:
    """A node of a tree: its sums, best split, and children once it is split."""

    depth: int
    grad: float
    hess: float
    rows: int
    gain: float | None = None            # None: not measured yet
    feature: int = -1
    bin: int = -1                        # rows with a bin up to this one go left
    left: int = -1
    right: int = -1
    hist: np.ndarray | None = field(default=None, repr=False)     # (features, bins, 3)


@dataclass(frozen=True)
class Rule:
    """What a split has to meet."""

    penalty: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 1e-3
    min_rows: int = 20

    def value(self, grad: float, hess: float) -> float:
        return -grad / (hess + self.penalty) if hess + self.penalty > 0 else 0.0

    def best(self, nodes: Sequence[Node]) -> None:
        """Set the nodes' best splits from their histograms; a gain of 0 when none is allowed."""
        step = max(1, (1 << 20) // max(1, nodes[0].hist.size)) if nodes else 1
        for at in range(0, len(nodes), step):
            self._best(nodes[at:at + step])

    def _best(self, nodes: Sequence[Node]) -> None:
        left = np.stack([n.hist for n in nodes]).cumsum(axis=2)[:, :, :-1]
        right = np.array([[[[n.grad, n.hess, n.rows]]] for n in nodes]) - left
        with np.errstate(divide="ignore", invalid="ignore"):
            score = lambda s: np.nan_to_num(s[..., 0] ** 2 / (s[..., 1] + self.penalty))
            totals = [n.grad ** 2 / (n.hess + self.penalty) if n.hess + self.penalty > 0 else 0.0 for n in nodes]
            gain = (score(left) + score(right) - np.array(totals)[:, None, None]) / 2 - self.min_gain
        allowed = ((left[..., 2] >= max(1, self.min_rows)) & (right[..., 2] >= max(1, self.min_rows))
                   & (left[..., 1] >= self.min_weight) & (right[..., 1] >= self.min_weight))
        gain = np.where(allowed, gain, -np.inf)
        for node, total, mine in zip(nodes, totals, gain):
            at = int(np.argmax(mine)) if mine.size else 0
            node.gain = 0.0
            # a gain within rounding of the parent's score is none
            if mine.size and mine.flat[at] > 1e-12 * max(1.0, abs(total)):
                node.gain, (node.feature, node.bin) = float(mine.flat[at]), (int(i) for i in np.unravel_index(at, mine.shape))


def split_node(tree: list[Node], i: int) -> None:
    """Two children for node i, with the sums its histogram gives."""
    n = tree[i]
    grad, hess, rows = (float(x) for x in n.hist[n.feature, :n.bin + 1].sum(axis=0))
    n.left, n.right = len(tree), len(tree) + 1
    tree.append(Node(n.depth + 1, grad, hess, round(rows)))
    tree.append(Node(n.depth + 1, n.grad - grad, n.hess - hess, n.rows - round(rows)))


def in_order(tree: list[Node], limit: int, floor: float = 0.0) -> Iterator[int]:
    """The nodes that can be split, the leaf of greatest gain first, for a tree of ``limit`` leaves; none whose gain is below ``floor``."""
    order = [(-tree[0].gain, 0)] if limit > 1 else []
    for _ in range(limit - 1):
        if not order or order[0][0] >= 0 or -order[0][0] < floor:
            break
        i = heapq.heappop(order)[1]
        yield i
        if tree[i].left >= 0:
            for c in (tree[i].left, tree[i].right):
                heapq.heappush(order, (-tree[c].gain, c))


def to_open(tree: list[Node], limit: int, floor: float) -> tuple[dict[int, int], float]:
    """Leaves whose split may be one of a tree of ``limit`` leaves, with the most leaves
    either side can then have; and the least gain a split of the tree can have. What is
    below the leaves is not known yet; when it is, it can only come between. So a leaf whose
    turn does not come without it is not split, and as long as one of those whose turn comes
    is not split, it or a node above it is next unless another has a greater gain."""
    found = list(in_order(tree, limit, floor))
    # a leaf without a histogram belongs to a finished subtree, which has all the leaves it can have in this tree
    opened = {i: limit - 1 - before for before, i in enumerate(found) if tree[i].left < 0 and tree[i].hist is not None}
    return opened, min((tree[i].gain for i in found), default=0.0) if len(found) == limit - 1 else floor


class Measure:
    """Histograms of nodes of a growing tree, and whole subtrees of small ones."""

    def histograms(self, tree: list[Node], wanted: Sequence[int]) -> dict[int, np.ndarray]:
        """(features, bins, [gradient, hessian, rows]) of the wanted nodes of the rows routed down ``tree``."""
        raise NotImplementedError

    def subtrees(self, tree: list[Node], wanted: Sequence[int], most: dict[int, int | None], floor: float) -> dict[int, list[Node]]:
        """The nodes below (and with) each wanted node, up to its ``most`` leaves and without splits of a gain
        below ``floor``; those not given are measured. None by default."""
        return {}


class LocalMeasure(Measure):
    """Histograms of rows held in memory: bins (rows, features), and gradients, hessians and numbers of equal rows (3, rows)."""

    def __init__(self, bins: np.ndarray, sums: np.ndarray, most: int):
        self.sums, self.size, self.width = sums, bins.shape[1], most + 1
        self.bins = np.ascontiguousarray(bins.T)
        self.rows = {0: np.arange(len(bins))}

    def histograms(self, tree, wanted):
        for i in list(self.rows):
            n = tree[i]
            if n.left >= 0:
                mine = self.rows.pop(i)
                goes = self.bins[n.feature].take(mine) <= n.bin
                self.rows[n.left], self.rows[n.right] = mine[goes], mine[~goes]
        return {i: self._histogram(self.rows[i]) for i in wanted}

    def _histogram(self, rows: np.ndarray) -> np.ndarray:
        w = self.sums.take(rows, axis=1)
        if len(rows) < 1 << 11:
            # few rows: a call per sum costs less than one per feature and sum
            cells = (self.bins.take(rows, axis=1) + np.arange(self.size)[:, None] * self.width).reshape(-1)
            sums = [np.bincount(cells, np.tile(x, self.size), self.size * self.width).reshape(self.size, self.width) for x in w]
        else:
            cells = [b.take(rows).astype(np.intp) for b in self.bins]
            sums = [[np.bincount(c, x, self.width) for c in cells] for x in w]
        return np.stack([np.reshape(x, (self.size, self.width)) for x in sums], axis=-1)


def grow(measure: Measure, root: Node, rule: Rule, max_leaves: int | None, max_depth: int | None, floor: float = 0.0) -> list[Node]:
    """The nodes of a tree; nodes without children are its leaves. With ``max_leaves``, no split has a gain below ``floor``."""
    tree = [root]

    def learn(fresh: Sequence[tuple[int, int, int]], most: dict[int, int | None], floor: float) -> None:
        """Gains of new siblings (parent, the one with fewer rows, the other), each with its ``most`` leaves at most."""
        here = [c for _, s, l in fresh for c in (s, l) if max_depth is None or tree[c].depth < max_depth]
        open_ = set(here)
        for _, small, large in fresh:
            for c in (small, large):
                if c not in open_:
                    tree[c].gain = 0.0
        grown = measure.subtrees(tree, here, most, floor) if here else {}
        left = [(p, s, l) for p, s, l in fresh if any(c in open_ and c not in grown for c in (s, l))]
        hists = measure.histograms(tree, [s for _, s, _ in left]) if left else {}
        seen = []
        for parent, small, large in left:
            for c, hist in ((small, hists[small]), (large, tree[parent].hist - hists[small])):
                if c not in grown:
                    tree[c].hist = hist
                    seen.append(tree[c])
        rule.best(seen)
        for i, nodes in grown.items():
            graft(tree, i, nodes)

    whole = measure.subtrees(tree, [0], {0: max_leaves}, floor)
    if whole:
        graft(tree, 0, whole[0])
    else:
        root.hist = measure.histograms(tree, [0])[0]
        if root.hist.size:
            root.grad, root.hess, rows = (float(x) for x in root.hist[0].sum(axis=0))       # every feature holds every row
            root.rows = round(rows)
        rule.best([root])
    while True:
        if max_leaves is None:
            opened = {i: None for i, n in enumerate(tree) if n.hist is not None and n_can_split(n, max_depth)}
        else:
            opened, floor = to_open(tree, max_leaves, floor)
        if not opened:
            break
        fresh, most = [], {}
        for i, left in opened.items():
            split_node(tree, i)
            most |= {tree[i].left: left, tree[i].right: left}
            fresh.append((i, *sorted((tree[i].left, tree[i].right), key=lambda c: (tree[c].rows, c))))
        learn(fresh, most, floor)
        for i in opened:
            tree[i].hist = None
    if max_leaves is not None:
        split = {i for i in in_order(tree, max_leaves, floor) if tree[i].left >= 0}
        for i, n in enumerate(tree):
            if i not in split:
                n.left = n.right = -1
    for n in tree:
        n.hist = None
    return tree


def graft(tree: list[Node], at: int, nodes: list[Node]) -> None:
    """Put a subtree in the place of a node."""
    base, depth = len(tree) - 1, tree[at].depth
    for k, n in enumerate(nodes):
        n.depth += depth
        n.left, n.right = (c + base if c > 0 else -1 for c in (n.left, n.right))
        if k:
            tree.append(n)
    tree[at] = nodes[0]


def n_can_split(n: Node, max_depth: int | None) -> bool:
    return bool(n.gain and n.gain > 0) and (max_depth is None or n.depth < max_depth)


def packed(tree: list[Node], rule: Rule) -> dict:
    """The tree as lists, children behind their parents, nodes out of reach left out."""
    order, todo = [], [0]
    while todo:
        i = todo.pop(0)
        order.append(i)
        if tree[i].left >= 0:
            todo += [tree[i].left, tree[i].right]
    at = {i: k for k, i in enumerate(order)}
    inner = [tree[i].left >= 0 for i in order]
    return {"feature": [tree[i].feature if s else 0 for i, s in zip(order, inner)],
            "bin": [tree[i].bin if s else -1 for i, s in zip(order, inner)],
            "left": [at[tree[i].left] if s else at[i] for i, s in zip(order, inner)],
            "right": [at[tree[i].right] if s else at[i] for i, s in zip(order, inner)],
            "value": [0.0 if s else rule.value(tree[i].grad, tree[i].hess) for i, s in zip(order, inner)],
            "gain": [tree[i].gain if s else 0.0 for i, s in zip(order, inner)],
            "depth": max(tree[i].depth for i in order)}


def reached(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The node of the tree each row of bins (rows, features) ends in."""
    node, flat, row = np.zeros(len(bins), np.intp), bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
    feature, cut, left, right = (np.asarray(tree[k], np.intp) for k in ("feature", "bin", "left", "right"))
    child = np.column_stack([right, left]).reshape(-1)
    for _ in range(tree["depth"]):
        goes = flat.take(row + feature.take(node)) <= cut.take(node)
        node = child.take(2 * node + goes)
    return node


def step_of(bins: np.ndarray, tree: dict) -> np.ndarray:
    """What the tree adds to the scores of the rows, before shrinkage."""
    return np.asarray(tree["value"], float)[reached(bins, tree)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of lists of ``size`` numbers as rows of a matrix; a missing list is a row of NaN."""
    if column.null_count:
        out = np.full((len(column), size), np.nan)
        out[np.asarray(column.is_valid())] = _matrix(column.drop_null(), size)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


@cache
def _code(task: Callable) -> bytes:
    return cloudpickle.dumps(task)


def sent(task: Callable, *args) -> Callable:
    """``task(rows, *args)`` for a partition's rows. The code is pickled once, not with every job; ``args`` are plain values."""
    code = _code(task)
    return lambda rows: pickle.loads(code)(rows, *args)


def blocks_of(df: DataFrame) -> RDD:
    """Rows (x: features, y: label, held: held out) as blocks of arrays (x, y, held) of at most ``BLOCK_ROWS`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0)
                block = _matrix(x, pc.max(pc.list_value_length(x)).as_py() or 0), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    def joined(rows: Iterable) -> Iterator[tuple]:
        held: list[tuple] = []
        for r in rows:
            held.append(pickle.loads(r[0]))
            if sum(len(b[1]) for b in held) + len(held[-1][1]) > BLOCK_ROWS:
                yield _joined(held)
                held = []
        if held:
            yield _joined(held)

    return df.mapInArrow(run, "block binary").rdd.mapPartitions(joined)


def _joined(blocks: list[tuple]) -> tuple:
    size = max(b[0].shape[1] for b in blocks)
    return np.concatenate([_sized(b[0], size) for b in blocks]), *(np.concatenate([b[k] for b in blocks]) for k in (1, 2))


def _sized(x: np.ndarray, size: int) -> np.ndarray:
    """Missing vectors alone do not know their size."""
    return x if x.shape[1] == size else np.full((len(x), size), np.nan)


def local_rows(size: int) -> int:
    """Most rows of ``size`` features whose tree one task grows."""
    return min(LOCAL_ROWS, LOCAL_BINS // max(1, size))


def added(pairs: RDD, numbers: int) -> dict:
    """The sum of the arrays of each key; ``numbers``: those that a partition gives."""
    if pairs.getNumPartitions() * numbers > DRIVER_NUMBERS:
        pairs = pairs.reduceByKey(np.add, pairs.getNumPartitions())
    out: dict = {}
    for key, value in pairs.collect():
        out[key] = out[key] + value if key in out else value
    drop_shuffles(pairs)
    return out


def drop_shuffles(rdd: RDD) -> None:
    """Delete the files of the shuffles that ``rdd`` reads."""
    rdd._jrdd.rdd().cleanShuffleDependencies(False)


@dataclass
class Summary:
    """Of the rows to fit: their number, sum of labels, features, and per feature its values (None: more than asked for) and rows with one."""

    rows: int
    labels: float
    values: list
    counts: list


def summary(raw: RDD, most: int) -> Summary:
    """``values`` has the ascending values of each feature that has at most ``most``."""
    def run(blocks: Iterable) -> Iterator[tuple]:
        n, total, values, counts = 0, 0.0, [], []
        for x, y, held in blocks:
            x, y = x[~held], y[~held]
            n, total = n + len(y), total + float(y.sum())
            while len(values) < x.shape[1]:
                values.append(np.empty(0))
                counts.append(0)
            for f in range(x.shape[1]):
                v = x[:, f][~np.isnan(x[:, f])]
                counts[f] += len(v)
                values[f] = _few(values[f], v, most)
        yield n, total, values, counts

    out = Summary(0, 0.0, [], [])
    for n, total, values, counts in raw.mapPartitions(run).collect():           # a row per partition
        out.rows, out.labels = out.rows + n, out.labels + total
        while len(out.values) < len(values):
            out.values.append(np.empty(0))
            out.counts.append(0)
        for f, v in enumerate(values):
            out.values[f], out.counts[f] = None if v is None else _few(out.values[f], v, most), out.counts[f] + counts[f]
    return out


def _few(values: np.ndarray | None, more: np.ndarray, most: int) -> np.ndarray | None:
    if values is None:
        return None
    both = np.unique(np.concatenate([values, more]))
    return both if len(both) <= most else None


def _image(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; zeros of both signs alike."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(image: int) -> float:
    bits = image ^ (1 << 63) if image >> 63 else image ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def bin_edges(raw: RDD, found: Summary, max_bins: int) -> list[list[float]]:
    """Per feature the ascending edges between bins: midpoints of neighbouring
    values when there are at most ``max_bins``, else the values at even positions
    of their order. A row is in the bin that counts the edges below its value.

    Positions are looked for in the doubles' bits, read as integers of the same
    order: each pass counts the values below even cuts of the brackets that hold
    the positions, until a bracket is one value."""
    size = len(found.values)
    edges: list[list[float]] = [[] for _ in range(size)]
    brackets: dict[int, dict[int, tuple[int, int]]] = {}          # per feature and position, the first and last image
    for f, v in enumerate(found.values):
        if v is None:
            brackets[f] = {math.floor((t + 1) * (found.counts[f] - 1) / max_bins): (0, (1 << 64) - 2) for t in range(max_bins - 1)}
        else:
            edges[f] = [(a + b) / 2 if math.isfinite(a + b) else a / 2 + b / 2 for a, b in zip(v.tolist(), v[1:].tolist())]
    while cuts := {f: _cuts({b for b in at.values() if b[0] < b[1]}) for f, at in brackets.items() if any(b[0] < b[1] for b in at.values())}:
        def run(blocks: Iterable) -> Iterator[tuple]:
            below = {f: np.zeros(len(c), np.int64) for f, c in cuts.items()}
            for x, _, held in blocks:
                x = _sized(x, size)
                for f, c in cuts.items():
                    v = x[~held, f]
                    below[f] += np.searchsorted(np.sort(_image(v[~np.isnan(v)])), c)
            yield from below.items()

        for f, below in added(raw.mapPartitions(run), sum(map(len, cuts.values()))).items():
            for at, (lo, hi) in brackets[f].items():
                if lo < hi:
                    k = int(np.searchsorted(below, at, side="right"))          # the first cut with more than ``at`` values below it
                    brackets[f][at] = max(lo, int(cuts[f][k - 1])), min(hi, int(cuts[f][k]) - 1) if k < len(cuts[f]) else hi
    for f, at in brackets.items():
        edges[f] = sorted({_value(lo) for lo, _ in at.values()})
    return edges


def _cuts(brackets: set[tuple[int, int]]) -> np.ndarray:
    """Ascending: the ends of all brackets and even cuts of each."""
    each, cuts = max(2, EDGE_CELLS // len(brackets)), set()
    for lo, hi in brackets:
        cuts.update(range(lo, hi + 1, max(1, -(-(hi + 1 - lo) // each))))
        cuts.add(hi + 1)
    return np.array(sorted(cuts), np.uint64)


def binned(values: np.ndarray, edges: Sequence[Sequence[float]], max_bins: int) -> np.ndarray:
    """Bin numbers: edges below the value; a missing value is in bin ``max_bins``."""
    out = np.empty(values.shape, np.int32)
    for f, e in enumerate(edges):
        v = values[:, f]
        out[:, f] = np.where(np.isnan(v), max_bins, np.searchsorted(np.asarray(e, float), v, side="left"))
    return out


def equal_joined(b: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple:
    """Rows with equal bins as one: bins, number of rows and sum of their labels."""
    words = _words(b)
    order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
    words = words[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(b)), bool), (words[1:] != words[:-1]).any(axis=1)])
    return (b[order[start]], *(np.add.reduceat(c[order], start) if len(start) else c for c in (n, s)))


def _words(b: np.ndarray) -> np.ndarray:
    """The bytes of each row as integers of 8 bytes."""
    wide = b.shape[1] * b.itemsize
    out = np.zeros((len(b), max(8, -(-wide // 8) * 8)), np.uint8)
    out[:, :wide] = np.ascontiguousarray(b).view(np.uint8).reshape(len(b), wide)
    return out.view(np.uint64)


def _dealt(b: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, the same for rows with equal bins."""
    h = np.zeros(len(b), np.uint64)
    for w in _words(b).T:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.intp)


def _pieces(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, its rows of the columns) for each part that has rows."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    ends = [*np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else []
    for lo, hi in zip([0, *ends], ends):
        yield int(part[lo]), tuple(c[lo:hi] for c in columns)


def _alike(parts: int) -> Callable:
    return lambda key: key % parts


def dealt_rows(raw: RDD, edges: Sequence[Sequence[float]], max_bins: int, parts: int) -> RDD:
    """(part, (bins, rows, sum of labels)) of the rows to fit, those with equal bins in the same part."""
    def run(blocks: Iterable) -> Iterator[tuple]:
        for x, y, held in blocks:
            b = narrow_bins(x[~held], edges, max_bins)
            b, n, s = equal_joined(b, np.ones(len(b)), y[~held])
            yield from _pieces(_dealt(b, parts), b, n, s)
    return raw.mapPartitions(run).partitionBy(parts, _alike(parts))


def stored_rows(dealt: RDD, init: float) -> RDD:
    """Blocks (bins, rows, sum of labels, score), rows with equal bins joined."""
    def joined(pairs: Iterable) -> Iterator[tuple]:
        found = [p for _, p in pairs]
        if found:
            b, n, s = equal_joined(*(np.concatenate(c) for c in zip(*found)))
            for at in range(0, len(b), BLOCK_ROWS):
                k = slice(at, at + BLOCK_ROWS)
                yield b[k], n[k], s[k], np.full(len(b[k]), init)
    return dealt.mapPartitions(joined)


def held_rows(raw: RDD, edges: Sequence[Sequence[float]], max_bins: int, init: float) -> RDD:
    """Blocks (bins, labels, score) of the rows held out."""
    def run(blocks: Iterable) -> Iterator[tuple]:
        for x, y, held in blocks:
            yield narrow_bins(x[held], edges, max_bins), y[held], np.full(int(held.sum()), init)
    return raw.mapPartitions(run)


def last_bin(edges: Sequence[Sequence[float]]) -> int:
    """The bin of missing values in stored rows: the first above those of all features."""
    return max(map(len, edges), default=0) + 1


def narrow_bins(values: np.ndarray, edges: Sequence[Sequence[float]], max_bins: int) -> np.ndarray:
    """Bin numbers in as few bytes as they take; a missing value is in bin ``last_bin``."""
    last, values = last_bin(edges), _sized(values, len(edges))
    b = binned(values, edges, max_bins)
    for f in range(b.shape[1]):
        b[np.isnan(values[:, f]), f] = last
    return b.astype(np.uint8 if last < 1 << 8 else np.uint16 if last < 1 << 16 else np.int32)


def advanced(blocks: Iterable, tree: dict, rate: float) -> Iterator[tuple]:
    """Blocks with the tree added to their scores."""
    for b, *columns, eta in blocks:
        yield b, *columns, eta + rate * step_of(b, tree)


class Kept:
    """Blocks that are persisted and written to the checkpoint folder. Their last array may be
    a score, which moves with every tree."""

    def __init__(self, blocks: RDD, stages: Stages):
        self.stages, self.file, self.before = stages, None, None
        self._keep(blocks, True)

    def _keep(self, blocks: RDD, write: bool) -> None:
        self.now = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if write:
            self.now.checkpoint()           # by the first job that reads it

    def gather(self) -> None:
        """One partition. Called, as ``advance``, once a job has read the blocks."""
        self._release()
        self.before = self.now
        self._keep(self.now.coalesce(1), False)

    def advance(self, tree: dict, rate: float, write: bool) -> None:
        """Move the scores."""
        self._release()
        self.before = self.now
        self._keep(self.now.mapPartitions(sent(advanced, tree, rate)), write)

    def _release(self) -> None:
        """Forget what the blocks no longer need."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        path = self.now.getCheckpointFile()
        if path and path != self.file:
            if self.file:
                self.stages.remove(self.file)
            self.file = path

    def close(self) -> None:
        self._release()
        self.now.unpersist()
        if self.file:
            self.stages.remove(self.file)


def sums_of(n: np.ndarray, s: np.ndarray, eta: np.ndarray, poisson: bool) -> np.ndarray:
    """(3, rows): gradient, hessian and number of equal rows."""
    weight = n * np.exp(eta) if poisson else n
    return np.stack([weight - s if poisson else n * eta - s, weight, n])


def count_nodes(blocks: Iterable, shape: dict, wanted: list[int], size: int, width: int, poisson: bool) -> Iterator[tuple]:
    """(node, histogram) of the wanted nodes."""
    slot = np.full(len(shape["left"]), -1)
    slot[wanted] = range(len(wanted))
    sums = np.zeros((len(wanted), size, width, 3))
    for b, n, s, eta in blocks:
        at = slot[reached(b, shape)]
        here = np.flatnonzero(at >= 0)
        at, b = at[here] * width, b[here]
        w = sums_of(n[here], s[here], eta[here], poisson)
        for f in range(size):
            cell = at + b[:, f]
            for k in range(3):
                sums[:, f, :, k] += np.bincount(cell, w[k], len(wanted) * width).reshape(-1, width)
    yield from ((i, h) for i, h in zip(wanted, sums) if h[..., 2].any())


def place_rows(blocks: Iterable, shape: dict, part: list[int], poisson: bool) -> Iterator[tuple]:
    """(part, (node, bins, gradients, hessians, numbers of rows)) of the nodes that have a part."""
    part = np.array(part)
    for b, n, s, eta in blocks:
        node = reached(b, shape)
        here = part[node] >= 0
        yield from _pieces(part[node[here]], node[here], b[here], *sums_of(n[here], s[here], eta[here], poisson))


def finish_nodes(pairs: Iterable, bins: int, rule: tuple, most: dict, depths: dict, floor: float) -> Iterator[tuple]:
    """(node, the nodes of its subtree)."""
    found = [p for _, p in pairs]
    if found:
        for i, (b, *w) in _pieces(*(np.concatenate(c) for c in zip(*found))):
            nodes = grow(LocalMeasure(b, np.stack(w), bins), Node(0, 0.0, 0.0, round(w[2].sum())), Rule(*rule), most[i], depths[i], floor)
            yield i, [tuple(getattr(n, f) for f in _FIELDS) for n in nodes]


class SparkMeasure(Measure):
    """Histograms of stored rows; one pass for all wanted nodes."""

    def __init__(self, stored: RDD, groups: int, poisson: bool, size: int, bins: int, rule: Rule, max_depth: int | None):
        self.stored, self.groups, self.poisson, self.size, self.bins, self.rule, self.max_depth = stored, groups, poisson, size, bins, rule, max_depth

    @staticmethod
    def _shape(tree: list[Node]) -> dict:
        return {"feature": [n.feature if n.left >= 0 else 0 for n in tree], "bin": [n.bin if n.left >= 0 else -1 for n in tree],
                "left": [n.left if n.left >= 0 else i for i, n in enumerate(tree)],
                "right": [n.right if n.left >= 0 else i for i, n in enumerate(tree)], "depth": max(n.depth for n in tree)}

    def histograms(self, tree, wanted):
        size, width = self.size, self.bins + 1
        pairs = self.stored.mapPartitions(sent(count_nodes, self._shape(tree), list(wanted), size, width, self.poisson))
        found = added(pairs, len(wanted) * size * width * 3)
        return {i: found[i] if i in found else np.zeros((size, width, 3)) for i in wanted}

    def subtrees(self, tree, wanted, most, floor):
        one, tasks = self.stored.getNumPartitions() == 1, 2 * self.stored.getNumPartitions()
        if self.groups > (most_rows := local_rows(self.size)):
            # many subtrees that do not know yet which gains are too small would mostly grow in vain
            if any(tree[i].rows > most_rows for i in wanted) or not floor and len(wanted) > tasks and most[wanted[0]] is not None:
                return {}
        # large nodes first, each to the part that has the fewest rows so far
        parts = 1 if one else min(len(wanted), tasks)
        loads, part = [(0, p) for p in range(parts)], [-1] * len(tree)
        for i in sorted(wanted, key=lambda i: (-tree[i].rows, i)):
            load, part[i] = heapq.heappop(loads)
            heapq.heappush(loads, (load + tree[i].rows, part[i]))
        depths = {i: None if self.max_depth is None else self.max_depth - tree[i].depth for i in wanted}
        placed = self.stored.mapPartitions(sent(place_rows, self._shape(tree), part, self.poisson))
        if not one:
            placed = placed.partitionBy(parts, _alike(parts))
        done = placed.mapPartitions(sent(finish_nodes, self.bins, astuple(self.rule), {i: most[i] for i in wanted}, depths, floor))
        out = {i: [Node(**dict(zip(_FIELDS, n))) for n in nodes] for i, nodes in done.collect()}         # a tree's nodes
        drop_shuffles(done)
        return out


_FIELDS = ("depth", "grad", "hess", "rows", "gain", "feature", "bin", "left", "right")


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    loss = Param(Params._dummy(), "loss", "squared | poisson", TypeConverters.toString)
    growth = Param(Params._dummy(), "growth", "leaf | depth", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree grown by leaf", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree (0: unlimited)", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "min rows per leaf", TypeConverters.toInt)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "min hessian per leaf", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "penalty on leaf values", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "gain a split must exceed", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "feature bins, missing values not counted", TypeConverters.toInt)
    checkpointEvery = Param(Params._dummy(), "checkpointEvery", "rounds between stored scores", TypeConverters.toInt)
    earlyStopping = Param(Params._dummy(), "earlyStopping", "on | off", TypeConverters.toString)
    validationFraction = Param(Params._dummy(), "validationFraction", "held-out share", TypeConverters.toFloat)
    nIterNoChange = Param(Params._dummy(), "nIterNoChange", "patience in rounds", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "minimal improvement of the held-out loss", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the hold-out", TypeConverters.toInt)

    def _defaults(self):
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", loss="squared", growth="leaf",
                         maxIter=100, learningRate=0.1, maxLeaves=31, maxDepth=0, minInstancesPerNode=20, minChildWeight=1e-3,
                         regLambda=0.0, gamma=0.0, maxBins=255, checkpointEvery=5, earlyStopping="off", validationFraction=0.1,
                         nIterNoChange=10, tol=1e-7, seed=42)


class BoostingRegressor(Estimator, _BoostParams):
    """Boosted trees on binned histograms; see the module's text for the method."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", loss="squared", growth="leaf",
                 maxIter=100, learningRate=0.1, maxLeaves=31, maxDepth=0, minInstancesPerNode=20, minChildWeight=1e-3, regLambda=0.0,
                 gamma=0.0, maxBins=255, checkpointEvery=5, earlyStopping="off", validationFraction=0.1, nIterNoChange=10,
                 tol=1e-7, seed=42):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BoostingModel":
        g = self.getOrDefault
        if g(self.loss) not in ("squared", "poisson"):
            raise ValueError("loss is 'squared' or 'poisson'")
        if g(self.growth) not in ("leaf", "depth"):
            raise ValueError("growth is 'leaf' or 'depth'")
        if g(self.earlyStopping) not in ("on", "off"):
            raise ValueError("earlyStopping is 'on' or 'off'")
        poisson, stop_early = g(self.loss) == "poisson", g(self.earlyStopping) == "on"
        y, feats = F.col(g(self.labelCol)).cast("double"), vector_to_array(F.col(g(self.featuresCol)))
        # the row decides whether it is held out, not its place in a partition
        draw = F.pmod(F.xxhash64(feats, y, F.lit(g(self.seed))), F.lit(1 << 20))
        held = (draw < int(g(self.validationFraction) * (1 << 20))) if stop_early else F.lit(False)
        ensure_checkpoint_dir(df.sparkSession)
        stages, rate, bins = Stages(df.sparkSession), g(self.learningRate), g(self.maxBins)
        # the input runs once, however many passes the edges take
        kept = [Kept(blocks_of(df.select(feats.alias("x"), y.alias("y"), held.alias("held")).where(F.col("y").isNotNull())), stages)]
        try:
            raw = kept[0]
            first = summary(raw.now, bins)
            if not first.rows or poisson and first.labels <= 0:
                raise ValueError("Poisson boosting needs a positive mean label" if poisson else "there is no row to fit")
            mean = first.labels / first.rows
            init = math.log(mean) if poisson else mean
            edges = bin_edges(raw.now, first, bins)
            parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-first.rows // PARTITION_ROWS)) if first.rows > local_rows(len(edges)) else 1
            dealt = dealt_rows(raw.now, edges, bins, parts)
            kept.append(rows := Kept(stored_rows(dealt, init), stages))
            groups = rows.now.map(lambda block: len(block[1])).sum()
            drop_shuffles(dealt)
            if stop_early:
                kept.append(out := Kept(held_rows(raw.now, edges, bins, init), stages))
                out.now.count()
            kept.pop(0).close()
            if groups <= local_rows(len(edges)) and parts > 1:
                rows.gather()
            rule = Rule(g(self.regLambda), g(self.gamma), g(self.minChildWeight), g(self.minInstancesPerNode))
            max_leaves, max_depth = g(self.maxLeaves) if g(self.growth) == "leaf" else None, g(self.maxDepth) or None
            trees: list[dict] = []
            losses: list[float] = []
            for r in range(g(self.maxIter)):
                if trees:
                    for k in kept:
                        k.advance(trees[-1], rate, r % g(self.checkpointEvery) == 0)
                measure = SparkMeasure(rows.now, groups, poisson, len(edges), last_bin(edges), rule, max_depth)
                trees.append(packed(grow(measure, Node(0, 0.0, 0.0, first.rows), rule, max_leaves, max_depth), rule))
                if stop_early:
                    losses.append(held_loss(out.now, trees[-1], rate, poisson))
                    patience = g(self.nIterNoChange)
                    if losses[-1] is None or len(losses) > patience and all(x > losses[-patience - 1] - g(self.tol) for x in losses[-patience:]):
                        break
        finally:
            for k in kept:
                k.close()
        return self._copyValues(BoostingModel(init=init, edges=edges, trees=trees))


def held_loss(held: RDD, tree: dict, rate: float, poisson: bool) -> float | None:
    """Mean loss of the rows held out once the tree is added; None when there are none."""
    found = held.mapPartitions(sent(losses_of, tree, rate, poisson)).collect()           # a row per block
    rows = sum(n for _, n in found)
    return math.fsum(x for x, _ in found) / rows if rows else None


def losses_of(blocks: Iterable, tree: dict, rate: float, poisson: bool) -> Iterator[tuple]:
    for b, y, eta in advanced(blocks, tree, rate):
        yield float(_loss(y, eta, poisson).sum()), len(y)


def _loss(y: np.ndarray, eta: np.ndarray, poisson: bool) -> np.ndarray:
    if poisson:
        some = y > 0
        return np.where(some, y * (np.log(np.where(some, y, 1.0)) - eta), 0.0) - y + np.exp(eta)
    return (y - eta) * (y - eta)


class BoostingModel(Model, _BoostParams, MLWritable, MLReadable):
    init = Param(Params._dummy(), "init", "score before the first tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, init=0.0, edges=None, trees=None):
        super().__init__()
        self._defaults()
        self._setDefault(init=0.0)
        kw = dict(self._input_kwargs)
        self.edges, self.trees = [list(e) for e in kw.pop("edges", None) or []], list(kw.pop("trees", None) or [])
        self._set(**kw)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        edges, trees, init, rate, bins = self.edges, self.trees, g(self.init), g(self.learningRate), g(self.maxBins)

        @F.arrow_udf("double")
        def scores(values: pa.Array) -> pa.Array:
            b = binned(_matrix(values, len(edges)), edges, bins)
            out = np.full(len(b), init)
            for t in trees:
                out = out + rate * step_of(b, t)
            return pa.array(out, pa.float64())

        score = scores(vector_to_array(g(self.featuresCol)))
        return df.withColumn(g(self.predictionCol), F.exp(score) if g(self.loss) == "poisson" else score)

    @property
    def featureImportances(self):
        """Gain of the splits on each feature, normalised to one."""
        total = np.zeros(len(self.edges))
        for t in self.trees:
            for f, gain in zip(t["feature"], t["gain"]):
                total[f] += gain
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def write(self) -> MLWriter:
        return _BoostingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostingReader()

    def copy(self, extra=None):
        that = super().copy(extra)
        that.edges, that.trees = list(self.edges), list(self.trees)
        return that


class _BoostingWriter(MLWriter):
    def __init__(self, model: BoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc, extraMetadata={"edges": self.model.edges, "trees": json.dumps(self.model.trees)})


class _BoostingReader(MLReader):
    def load(self, path: str) -> BoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = BoostingModel(edges=metadata["edges"], trees=json.loads(metadata["trees"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
