"""Operator 9: token ids packed into fixed-length rows.

Documents become token ids and an end token; a document longer than a row is
split into pieces of one row each and a rest, losslessly. Pieces are packed by
best fit decreasing: longest first, each into the row with the least room that
still suffices. Room is looked up in a segment tree over capacities 0 to the
row length, whose leaves list the rows with that much room left.

Packing needs no shuffle: every task packs what it reads, in blocks of about
``BLOCK_TOKENS`` tokens, so memory is bounded and a lost task repeats only
itself. A row of the result holds its ids and positions (little-endian
unsigned 16 or 32 bits), the cumulative segment lengths, and which part of
which document every segment is; positions restart at 0 at every segment.
``unpack`` gives the documents back.

Defined cases: null text counts as empty, and an empty text is its end token
alone; very long texts are split, never cut; repeated rows are packed
repeatedly; pieces of equal length keep the order of the table; an empty table
gives an empty table; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TOKENS, BLOCK_TOKENS = 2048, 4 << 20

SCHEMA = ("row_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, "
          "doc_ids array<bigint>, starts array<bigint>, lasts array<boolean>")


class CapacityTree:
    """Segment tree over capacities: finds the least one, from a given size up, that some row has."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of a best fit, which leaves the tree."""
        some, i = self.some, least + self.size
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):     # up, until a subtree to the right holds one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            some[i] = 0
            while i > 1:
                i >>= 1
                some[i] = some[2 * i] | some[2 * i + 1]
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Items of every row; no length is over ``most``."""
    tree, rows = CapacityTree(most), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            rows.append([i])
            room, row = most - n, len(rows) - 1
        else:
            room, row = got[0] - n, got[1]
            rows[row].append(i)
        if room:
            tree.put(room, row)
    return rows


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int, key: str = "doc_id",
         text: str = "text", row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Packed rows of ``docs``; ``encoder()`` is called once a task and gives
    the function from text to ids. Rests of rows are filled with ``end_id``."""
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def rows(block: list[tuple[int | None, int, bool, np.ndarray]], number: int) -> pa.RecordBatch:
        lengths = np.asarray([len(p[3]) for p in block])
        packed = best_fit_decreasing(lengths, row_tokens)
        ids, positions, cu, docs_, starts, lasts, used = [], [], [], [], [], [], []
        ramp = np.arange(row_tokens, dtype=kind)
        for items in packed:
            out, pos = np.full(row_tokens, end_id, dtype=kind), np.zeros(row_tokens, dtype=kind)
            ends = np.cumsum(lengths[items])
            for i, b in zip(items, ends.tolist()):
                a = b - int(lengths[i])
                out[a:b], pos[a:b] = block[i][3], ramp[:b - a]
            ids.append(out.tobytes())
            positions.append(pos.tobytes())
            cu.append([0, *ends.tolist()])
            docs_.append([block[i][0] for i in items])
            starts.append([block[i][1] for i in items])
            lasts.append([block[i][2] for i in items])
            used.append(int(ends[-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(packed), dtype=np.int64) + number), pa.array(used, pa.int32()), pa.array(ids, pa.binary()),
             pa.array(positions, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(docs_, pa.list_(pa.int64())),
             pa.array(starts, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.bool_()))],
            names=["row_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts", "lasts"])

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder()
        number = TaskContext.get().partitionId() << 32
        block, size = [], 0
        for b in batches:
            for t, doc in zip(b.column(0), b.column(1)):
                ids = np.append(np.asarray(encode(t.as_py() or ""), dtype=kind), kind.type(end_id))
                for at in range(0, len(ids), row_tokens):
                    block.append((doc.as_py(), at, at + row_tokens >= len(ids), ids[at:at + row_tokens]))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    out = rows(block, number)
                    yield from (out.slice(i, 512) for i in range(0, out.num_rows, 512))
                    number, block, size = number + out.num_rows, [], 0
        if block:
            out = rows(block, number)
            yield from (out.slice(i, 512) for i in range(0, out.num_rows, 512))

    return docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("id")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, end_id: int) -> DataFrame:
    """(doc_id, start, last, ids): every segment with its ids, without the end
    token. Segments of a document put together by ``start`` are its ids."""
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches):
        for b in batches:
            ids, cu, docs, starts, lasts = (b.column(i).to_pylist() for i in range(5))
            flat = [(d, s, last, np.frombuffer(x, kind)[a:e - last].tolist()) for x, c, dd, ss, ll in zip(ids, cu, docs, starts, lasts)
                    for a, e, d, s, last in zip(c, c[1:], dd, ss, ll)]
            cols = list(zip(*flat)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()),
                                              pa.array(cols[3], pa.list_(pa.int32()))], names=["doc_id", "start", "last", "ids"])
    return packed.select("ids", "cu_seqlens", "doc_ids", "starts", "lasts").mapInArrow(
        run, "doc_id long, start long, last boolean, ids array<int>")


def ranked_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Encoder of a file of byte-pair ranks; tasks get its content (under 1 MB) with the function."""
    with open(path, "rb") as f:
        content = f.read()

    def make():
        import base64

        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return make


def write_packed(packed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes packed rows as Parquet: one file per task, rows of one length."""
    packed.write.mode(mode).parquet(path)
