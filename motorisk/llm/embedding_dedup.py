"""Operator 4: embedding near-dedup by product quantisation.

Vectors of one label link when their cosine, in double precision, is at least
``threshold``.

1. Equal vectors of a label become one node with a count.
2. A bounded sample trains coarse centroids (spherical k-means) and, on the
   residuals, codebooks for ``SUBSPACES`` groups of dimensions. Every node is
   assigned to its nearest centroid's inverted list and coded; its coding error
   is kept.
3. A node probes every list its neighbours can lie in: the distance to the
   bisecting plane between its own centroid and the list's is at most the
   radius of the threshold (exact), or ``sigmas`` times the spread of a displacement
   of that length along the difference of the centroids, when that is less. The
   spread is the largest of the residuals' of the sample, of those of the two
   lists (with ``ENOUGH`` sample vectors) and of an even one over all dimensions, so vectors that vary in few directions are
   probed as far as these need (recall is measured in the tests).
4. A list is cut into blocks; queries stream past a block. Table lookups give
   the asymmetric distance to every coded vector; the triangle inequality with
   the stored coding error drops only vectors that cannot link; the rest are
   ranked by exact cosine.
5. Tasks return link counts per vector and the links that join components
   (union-find inside the task), never all pairs.

Defined cases: a vector that is null, zero, or holds a null or a non-finite
component, or whose label or id is null, links with nothing; vectors of
different length never link; equal vectors count as separate vectors; -0.0 is
0.0; an empty table stays empty; other columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, components

THRESHOLD = 0.93
#: Vectors (and bytes of them) the quantiser is trained on, at most.
FIT_VECTORS, FIT_BYTES = 20_000, 16 << 20
#: Vectors per inverted list aimed at, most lists, rows of a list compared at once, queries at once.
LIST_ROWS, MOST_LISTS, BLOCK, BATCH = 1000, 2048, 2048, 256
SUBSPACES, CODES = 8, 64
SIGMAS = 5.0
#: Sample vectors from which a list has a spread of its own.
ENOUGH = 64
SLACK = 1e-6
SEED = 5


class Quantiser:
    """Coarse centroids and residual codebooks for one vector length."""

    def __init__(self, unit: np.ndarray, lists: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        lists = max(1, min(lists, len(unit) // 8))
        c = unit[rng.choice(len(unit), lists, replace=False)].copy()
        for _ in range(8):
            own = np.argmax(unit @ c.T, axis=1)
            total = np.zeros_like(c)
            np.add.at(total, own, unit)
            norm = np.linalg.norm(total, axis=1)
            c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
        self.centroids = c
        self.cuts = [x for x in np.array_split(np.arange(unit.shape[1]), SUBSPACES) if len(x)]
        own = np.argmax(unit @ c.T, axis=1)
        rest = unit - c[own]
        self.spread = self._spread(rest, own)
        self.books = [self._kmeans(rest[:, x], rng) for x in self.cuts]

    def _spread(self, rest: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Standard deviation, for displacements of length 1, along the difference
        of every two centroids (symmetric)."""
        c = self.centroids
        gap = np.maximum(2 - 2 * c @ c.T, 1e-12)

        def share(v):
            """(list, list) mean square along the difference, as part of the whole."""
            m = v.T @ v
            x = c @ m @ c.T
            along = np.diag(x)[:, None] + np.diag(x)[None] - x - x.T
            return along / gap / max(np.trace(m), 1e-300)
        out = np.maximum(share(rest), 1 / rest.shape[1])
        for i in range(len(c)):
            v = rest[own == i]
            if len(v) < ENOUGH:
                continue
            p = v @ c.T
            along = ((p[:, [i]] - p) ** 2).sum(0) / gap[i]
            out[i] = np.maximum(out[i], along / max((v ** 2).sum(), 1e-300))
        return np.sqrt(np.minimum(np.maximum(out, out.T), 1.0))

    @staticmethod
    def _nearest(v: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmin((book ** 2).sum(1) - 2 * (v @ book.T), axis=1)

    def _kmeans(self, v: np.ndarray, rng) -> np.ndarray:
        book = v[rng.choice(len(v), min(CODES, len(v)), replace=False)].copy()
        for _ in range(6):
            own = self._nearest(v, book)
            total, count = np.zeros_like(book), np.bincount(own, minlength=len(book))
            np.add.at(total, own, v)
            book[count > 0] = total[count > 0] / count[count > 0, None]
        return book

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error) of unit vectors."""
        own = np.argmax(unit @ self.centroids.T, axis=1)
        rest = unit - self.centroids[own]
        codes = np.stack([self._nearest(rest[:, x], b) for x, b in zip(self.cuts, self.books)], axis=1)
        back = np.empty_like(unit)
        for m, (x, b) in enumerate(zip(self.cuts, self.books)):
            back[:, x] = b[codes[:, m]]
        return own, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, unit: np.ndarray, own: np.ndarray, radius: float, sigmas: float | None = SIGMAS) -> np.ndarray:
        """Mask (vector, list) of the lists to search; see step 3."""
        near = unit @ self.centroids.T
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.centroids @ self.centroids.T))[own]
        reach = radius if sigmas is None else radius * np.minimum(1.0, sigmas * self.spread)[own]
        return near[np.arange(len(unit)), own][:, None] - near <= reach * gap + SLACK

    def distances(self, unit: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of list ``of``."""
        rest = unit - self.centroids[of]
        total = np.zeros((len(unit), len(codes)))
        for m, (x, b) in enumerate(zip(self.cuts, self.books)):
            table = ((rest[:, x, None] - b.T[None]) ** 2).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def _units(col) -> np.ndarray:
    """Vectors divided by their length. They are scaled by a power of two first,
    which changes no digit and keeps the squares of any finite component in range."""
    v = np.stack([np.frombuffer(x, "<f8") for x in col]) if len(col) else np.zeros((0, 1))
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.linalg.norm(v, axis=1)[:, None]


def _parsed(batches):
    """Vectors (column 0) as bytes of doubles; null where a vector links with nothing."""
    for b in batches:
        out = []
        for v in b.column(0):
            x = v.as_py()
            a = np.asarray(x, dtype="<f8") + 0.0 if x is not None and None not in x else np.zeros(0)
            fine = len(a) and np.isfinite(a).all() and a.any()
            out.append(a.tobytes() if fine else None)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], names=[*b.schema.names[1:], "vec"])


def _place(shared, threshold: float, sigmas: float | None):
    """Nodes to rows of the search: role 0 in its own list, role 1 in every list it probes."""
    radius = math.sqrt(2 - 2 * threshold)

    def run(batches):
        models = shared.value
        for b in batches:
            rows = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            dim = np.asarray([len(v) // 8 for v in rows["vec"]])
            for d in np.unique(dim):
                idx = np.flatnonzero(dim == d)
                q = models[int(d)]
                for at in range(0, len(idx), 4096):
                    part = idx[at:at + 4096]
                    unit = _units([rows["vec"][i] for i in part])
                    own, codes, err = q.code(unit)
                    mask = q.probes(unit, own, radius, sigmas)
                    mask &= np.arange(len(q.centroids)) >= own[:, None]      # each pair of lists from one side
                    who, where = np.nonzero(mask)
                    for role, w, ls in ((0, np.arange(len(part)), own), (1, who, where)):
                        pick = part[w]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([rows["label"][i] for i in pick], pa.string()), pa.array(np.full(len(pick), d, np.int32)),
                             pa.array(ls.astype(np.int32)), pa.array(np.full(len(pick), role, np.int32)),
                             pa.array([rows["gid"][i] for i in pick], pa.int64()), pa.array([rows["copies"][i] for i in pick], pa.int64()),
                             pa.array(own[w].astype(np.int32)), pa.array([rows["vec"][i] for i in pick], pa.binary()),
                             pa.array([codes[i].tobytes() if role == 0 else b"" for i in w], pa.binary()),
                             pa.array(err[w] if role == 0 else np.zeros(len(w)))],
                            names=["label", "dim", "list", "role", "gid", "copies", "own", "vec", "codes", "err"])
    return run


def _search(shared, threshold: float):
    """Rows sorted by (label, dim, list, block, role): a block, then the queries of its list."""
    radius = math.sqrt(2 - 2 * threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    class Block:
        def __init__(self, key):
            self.key, self.rows, self.queries, self.edges = key, [], [], []

        def seal(self):
            self.unit = _units([r[0] for r in self.rows])
            self.gid = np.asarray([r[1] for r in self.rows], np.int64)
            self.copies = np.asarray([r[2] for r in self.rows], np.int64)
            self.codes = np.stack([np.frombuffer(r[3], np.uint8) for r in self.rows])
            self.err = np.asarray([r[4] for r in self.rows])
            self.count = np.zeros(len(self.rows), np.int64)
            self.up = np.arange(len(self.rows))
            self.rows = None

        def root(self, i):
            while self.up[i] != i:
                self.up[i] = self.up[self.up[i]]
                i = self.up[i]
            return i

        def ask(self):
            """Counts of the gathered queries, as rows (gid, null, links)."""
            if not self.queries or self.key is None:
                return None
            if self.rows is not None:
                if not self.rows:
                    self.queries = []
                    return None
                self.seal()
            q = shared.value[self.key[1]]
            unit = _units([r[0] for r in self.queries])
            gid = np.asarray([r[1] for r in self.queries], np.int64)
            copies = np.asarray([r[2] for r in self.queries], np.int64)
            inside = np.asarray([r[3] for r in self.queries]) == self.key[2]
            near = q.distances(unit, self.key[2], self.codes) - self.err <= radius + SLACK
            near &= ~inside[:, None] | (gid[:, None] < self.gid)            # inside a list each pair once
            i, j = np.nonzero(near)
            hit = np.einsum("ij,ij->i", unit[i], self.unit[j]) >= threshold
            i, j = i[hit], j[hit]
            found = np.bincount(i, weights=self.copies[j], minlength=len(gid)).astype(np.int64)
            self.count += np.bincount(j, weights=copies[i], minlength=len(self.gid)).astype(np.int64)
            for x, first, last in zip(*np.unique(i, return_index=True), np.append(np.unique(i, return_index=True)[1][1:], len(i))):
                roots = sorted({self.root(y) for y in j[first:last].tolist()})
                self.edges.append((int(gid[x]), int(self.gid[roots[0]])))
                for r in roots[1:]:
                    self.up[r] = roots[0]
                    self.edges.append((int(gid[x]), int(self.gid[r])))
            self.queries = []
            some = found > 0
            return gid[some], found[some]

        def close(self):
            out = [self.ask()]
            if self.rows is None:
                some = self.count > 0
                out.append((self.gid[some], self.count[some]))
            return [x for x in out if x is not None]

    def counts(gid, n):
        return pa.RecordBatch.from_arrays([pa.array(gid), pa.nulls(len(gid), pa.int64()), pa.array(n)], schema=schema)

    def links(edges):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64()),
                                           pa.array([0] * len(edges), pa.int64())], schema=schema)

    def run(batches):
        block = Block(None)
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                key = (cols["label"][i], cols["dim"][i], cols["list"][i], cols["block"][i])
                if key != block.key:
                    for out in block.close():
                        yield counts(*out)
                    if block.edges:
                        yield links(block.edges)
                    block = Block(key)
                if cols["role"][i] == 0:
                    block.rows.append((cols["vec"][i], cols["gid"][i], cols["copies"][i], cols["codes"][i], cols["err"][i]))
                else:
                    block.queries.append((cols["vec"][i], cols["gid"][i], cols["copies"][i], cols["own"][i]))
                    if len(block.queries) >= BATCH and (out := block.ask()) is not None:
                        yield counts(*out)
        for out in block.close():
            yield counts(*out)
        if block.edges:
            yield links(block.edges)
    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, sigmas: float | None = SIGMAS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row. Without ``sigmas`` every
    list a neighbour can lie in is probed, and no link is missed."""
    spark = df.sparkSession
    sc = spark.sparkContext
    st = Stages(spark)
    raw = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(key).cast("long").alias("id"),
                    F.col(label).cast("string").alias("label"))
    parsed = raw.mapInArrow(_parsed, "id long, label string, vec binary")
    fine = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = st.write(parsed.withColumn("gid", F.when(fine, F.xxhash64("label", "vec"))), "vectors")
    nodes = st.write(rows.where("gid is not null").groupBy("gid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")

    models = {}
    # one small row per vector length
    for dim, n in nodes.groupBy((F.length("vec") / 8).cast("int")).count().collect():
        most = min(FIT_VECTORS, FIT_BYTES // (8 * dim))
        sample = (nodes.where(F.length("vec") == 8 * dim).orderBy(F.xxhash64("gid", F.lit(SEED)), "gid").limit(most)
                  .select("vec").collect())
        models[dim] = Quantiser(_units([r.vec for r in sample]), min(MOST_LISTS, math.ceil(n / LIST_ROWS)))
    shared = sc.broadcast(models)

    placed = st.write(nodes.select("gid", "label", "vec", "copies").mapInArrow(
        _place(shared, threshold, sigmas),
        "label string, dim int, list int, role int, gid long, copies long, own int, vec binary, codes binary, err double"), "placed")
    cell = ["label", "dim", "list"]
    blocks = placed.where("role = 0").groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(blocks, cell).withColumn("block", F.explode(F.when(
        F.col("role") == 0, F.array(F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("blocks") - 1))))
    found = (dealt.select(*cell, "block", "role", "gid", "copies", "own", "vec", "codes", "err")
             .repartition(*cell, "block").sortWithinPartitions(*cell, "block", "role", "gid")
             .mapInArrow(_search(shared, threshold), "a long, b long, n long"))
    found = st.write(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("gid"), "component")
    per_node = (nodes.select("gid", "id", "copies").join(counts, "gid", "left").join(groups, "gid", "left")
                .withColumn("component", F.coalesce("component", "gid")))
    least = per_node.groupBy("component").agg(F.min("id").alias("least"))
    per_node = per_node.join(least, "component").select(
        "gid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "least")
    out = rows.select("id", "gid").join(per_node, "gid", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
