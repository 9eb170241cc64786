"""Operator 12: whitening of embeddings, with components from contour integrals.

Entries become integers x = floor(1024 c) + 100000. Three passes over the
vectors follow, each a map over Arrow batches whose results per task are one row
per dimension: sums (exact), covariance of the entries centred at their mean,
and covariance of the whitened values. The leading components are found by
FEAST: counts of eigenvalues above a shift (Sylvester's law, from the signs of an
LDL^T factorisation with 1x1 and 2x2 pivots) cut the top of the spectrum into
intervals of at most ``SLICE`` eigenvalues; a task for each interval integrates
the resolvent (zI - V)^-1 around it by Gauss-Legendre nodes on the circle,
applied to a block of vectors, extracts eigenpairs from the block by
Rayleigh-Ritz, and repeats until the residuals are at rounding. An interval with
fewer pairs than its count fails. One more Rayleigh-Ritz step joins the intervals.

Scale: what leaves a task is dims x dims numbers at most, added up in Spark in
two levels and in a fixed order; the driver and each interval's task hold the
covariance alone (dims squared doubles, whatever the number of rows). The vectors
are read from the input four times and never shuffled.

Defined cases: null vectors and those that hold null or non-finite entries, or
entries that do not fit the integers (|1024 c| of 2^52 or more), are dropped;
vectors shorter than the longest count as continued with zeros; equal rows count
each; components whose eigenvalue is not above ``RANK`` times the largest do not
exist, so constant vectors and a single row give no rows, as does an empty table;
of equal eigenvalues any orthogonal choice is taken, the same for all rows; a
deviation beyond 64 bits is null; other columns are ignored, whatever their
names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000          # fixed values of the task
LARGEST = float(1 << 52)
SLICE, NODES, ROUNDS, RANK = 4, 8, 40, 1e-11
ZERO = OFFSET
LOW_BITS = 26


def integers(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, x): which vectors of a batch stay, and these as rows of integers,
    continued with the integer of zero up to ``dims`` or the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = np.asarray(column.is_valid())
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()                                     # entries of the lists that are not null
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    ends = np.cumsum(lengths)
    scaled = np.floor(np.where(np.isfinite(values), values, 0.0) * SCALE)
    bad = ~np.isfinite(values) | ~(np.abs(scaled) < LARGEST)
    upto = np.concatenate([[0], np.cumsum(bad)])
    kept = present & (upto[ends] == upto[ends - lengths])
    width = int(lengths[kept].max(initial=0)) if dims is None else dims
    x = np.full((int(kept.sum()), width), ZERO, dtype=np.int64)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
    stays = kept[row_of]
    x[(np.cumsum(kept) - 1)[row_of[stays]], place[stays]] = scaled[stays].astype(np.int64) + OFFSET
    return kept, x


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums of each dimension; the mean as integer and rest."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: the integers are subtracted exactly first."""
        whole = self.whole
        rest = np.array([(s - int(m) * self.n) / self.n for s, m in zip(self.sums, whole)])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of every row, exact; null beyond 64 bits."""
        if not x.size:
            return [0] * len(x)
        whole = self.whole
        near = x - whole
        rest = [int(m) * self.n - s for s, m in zip(self.sums, whole)]
        widest = (int(np.abs(near).max()) + 1) * self.n
        if widest * widest * x.shape[1] < 1 << 63:
            y = near * self.n + np.array(rest, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n + r) ** 2 for a, r in zip(row, rest)) for row in near]
        return [d if d < 1 << 63 else None for d in exact]


def centre_of(vectors: DataFrame) -> Centre | None:
    """Count and sums of the column ``v``; None without any vector."""
    def run(batches):
        n, count, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            _, x = integers(b.column(0))
            n, d = n + len(x), max(x.shape[1], len(count))
            count, high, low = (np.pad(a, (0, d - len(a))) for a in (count, high, low))
            w = x.shape[1]
            count[:w] += len(x)
            high[:w] += (x >> LOW_BITS).sum(axis=0)
            low[:w] += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        dims = [-1, *range(len(count))]
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), *(pa.array([0, *a.tolist()] if k else [n, *a.tolist()], pa.int64())
                                                                        for k, a in enumerate((count, high, low)))], names=["dim", "count", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r.dim: r for r in vectors.mapInArrow(run, "dim int, count long, high long, low long").groupBy("dim")
             .agg(exact("count"), exact("high"), exact("low")).collect()}          # a row per dimension
    n = int(found[-1]["count"]) if -1 in found else 0
    if not n:
        return None
    # what is missing of a shorter vector is the integer of zero
    sums = [(int(r.high) << LOW_BITS) + int(r.low) + (n - int(r["count"])) * ZERO for _, r in sorted(found.items())[1:]]
    return Centre(n, tuple(sums))


ROWS = "i int, part int, entries array<double>"


def covariance(vectors: DataFrame, centre: Centre, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of these times ``turn``."""
    dims = len(centre.sums)
    shared = vectors.sparkSession.sparkContext.broadcast((centre, turn))
    width = dims if turn is None else turn.shape[1]

    def run(batches):
        c, t = shared.value
        total = np.zeros((width, width))
        for b in batches:
            z = c.centred(integers(b.column(0), dims)[1])
            z = z if t is None else z @ t
            total += z.T @ z
        yield _rows(np.arange(width), np.full(width, TaskContext.get().partitionId()), total)

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = np.asarray(table.column("entries").combine_chunks().flatten()).reshape(-1, width)
        return pa.Table.from_batches([_rows(table.column("i").to_numpy()[:1], table.column("part").to_numpy()[:1], rows.sum(axis=0)[None])])

    partial = vectors.mapInArrow(run, ROWS)
    some = partial.groupBy("i", F.expr("part % 64")).applyInArrow(added, ROWS)
    got = some.groupBy("i").applyInArrow(added, ROWS).orderBy("i").collect()       # dims rows
    shared.unpersist()
    v = np.array([r.entries for r in got]).reshape(width, width) / centre.n
    return (v + v.T) / 2


def _rows(i: np.ndarray, part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(part, pa.int32()), entries], names=["i", "part", "entries"])


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above the shift: positive pivots of an LDL^T factorisation of v - shift."""
    a, positive, alpha = v - shift * np.eye(len(v)), 0, (1 + 17 ** 0.5) / 8
    while len(a):
        size = 1
        if len(a) > 1:
            r = 1 + int(np.argmax(np.abs(a[1:, 0])))
            off = abs(a[r, 0])
            if abs(a[0, 0]) < alpha * off:
                around = np.abs(a[r])
                around[r] = 0
                if abs(a[0, 0]) * around.max() < alpha * off * off:
                    size = 1 if abs(a[r, r]) >= alpha * around.max() else 2
                    swap = np.arange(len(a))
                    swap[[size - 1, r]] = swap[[r, size - 1]]
                    a = a[np.ix_(swap, swap)]
        pivot, below = a[:size, :size], a[size:, :size]
        if size == 2:
            det, trace = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] ** 2, pivot[0, 0] + pivot[1, 1]
            positive += 1 if det < 0 else 2 if trace > 0 else 0
        else:
            positive += int(pivot[0, 0] > 0)
            if pivot[0, 0] == 0:
                a = a[1:, 1:]
                continue
        a = a[size:, size:] - below @ np.linalg.solve(pivot, below.T)
    return positive


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the k largest eigenvalues, at most
    ``SLICE`` each unless they lie too close to be told apart."""
    top = float(np.abs(v).sum(axis=1).max())
    if top == 0:
        return []
    safe = 1e-10 * top
    out: list[tuple[float, float, int]] = []
    todo = [(-0.01 * top, 1.01 * top, len(v), 0)]
    while todo:
        low, high, above_low, above_high = todo.pop()
        if above_high >= k or above_low == above_high:
            continue
        if above_low - above_high > SLICE and high - low > 1e-7 * top:
            for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
                cut = low + share * (high - low)
                n = count_above(v, cut)
                if n == count_above(v, cut - safe) == count_above(v, cut + safe):       # not at an eigenvalue
                    todo += [(low, cut, above_low, n), (cut, high, n, above_high)]
                    break
            else:
                out.append((low, high, above_low - above_high))
            continue
        out.append((low, high, above_low - above_high))
    return out


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of v in the interval (values, vectors as columns)."""
    n, top = len(v), float(np.abs(v).sum(axis=1).max())
    size = min(n, 2 * count + 6)
    x, weight = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, max((high - low) / 2, 1e-7 * top)
    arc = radius * np.exp(0.5j * np.pi * (x + 1))               # the upper half circle; the lower one is its mirror image
    block = np.random.default_rng(12).standard_normal((n, size))
    best = None
    for _ in range(ROUNDS):
        filtered = sum(w / 2 * (a * np.linalg.solve((middle + a) * np.eye(n) - v, block)).real for a, w in zip(arc, weight))
        q, _ = np.linalg.qr(filtered)
        values, turn = np.linalg.eigh(q.T @ v @ q)
        block = q @ turn
        inside = (values > low) & (values <= high)
        if inside.sum() != count:
            continue
        residual = float(np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0).max())
        if best is not None and residual >= 0.5 * best[0]:      # no longer falling
            if best[0] > 1e-10 * top:
                continue
            return best[1], best[2]
        best = (residual, values[inside], block[:, inside])
    if best is None or best[0] > 1e-10 * top:
        raise ArithmeticError(f"the interval ({low}, {high}] holds {count} eigenvalues; not all were found")
    return best[1], best[2]


def components(spark: SparkSession, v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns;
    fewer if others vanish. Every interval is a task."""
    pieces = intervals(v, min(k, len(v)))
    if not pieces:
        return np.zeros(0), np.zeros((len(v), 0))
    shared = spark.sparkContext.broadcast(v)

    def run(batches):
        for b in batches:
            for low, high, count in zip(*(c.to_pylist() for c in b.columns)):
                _, found = feast(shared.value, low, high, count)
                yield _rows(np.zeros(count), np.zeros(count), np.ascontiguousarray(found.T))

    frame = spark.createDataFrame(pieces, "low double, high double, count int").repartition(len(pieces))
    found = np.array([r.entries for r in frame.mapInArrow(run, ROWS).collect()])    # about k vectors
    shared.unpersist()
    q, _ = np.linalg.qr(found.T)
    values, turn = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values)[:k]
    order = order[values[order] > RANK * values.max()] if values.max() > 0 else order[:0]
    vectors = (q @ turn)[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * signs


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For every vector and component up to k: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    spark = df.sparkSession
    vectors = df.select(F.col(embedding).cast("array<double>").alias("v"))
    nothing = spark.createDataFrame([], OUTPUT)
    centre = centre_of(vectors)
    if centre is None or not centre.sums:
        return nothing
    v = covariance(vectors, centre)
    values, found = components(spark, v, k)
    m = len(values)
    if not m:
        return nothing
    turn = found / np.sqrt(values)
    error = float(np.abs(covariance(vectors, centre, turn) - np.eye(m)).max())
    shared = spark.sparkContext.broadcast((centre, turn, values / np.trace(v), error))
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, t, explained, off = shared.value
        for b in batches:
            kept, x = integers(b.column(1), len(c.sums))
            white, rows = c.centred(x) @ t, len(x)
            ids = b.column(0).filter(pa.array(kept)).take(pa.array(np.repeat(np.arange(rows), m)))
            deviation = pa.array(c.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), m)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, c.n)), deviation,
                pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, off))], names=names)

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, OUTPUT)
