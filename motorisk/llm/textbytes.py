"""Word and n-gram hashes of whole Arrow text columns, computed on the UTF-8
bytes with numpy (no Python object per word).

A word is a maximal run of bytes other than space, tab, newline, vertical tab,
form feed and carriage return; A-Z count as a-z. Hashes are 64 bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (methods of arrays need it)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets with one more entry than rows); null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer text is a range of its own)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the row of each word, and first word index per row (rows + 1 entries)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data), dtype=bool)
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = True
    start_mask = solid.copy()
    start_mask[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(start_mask)
    del start_mask, first
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(solid)                       # solid bytes, word after word
    begin = np.searchsorted(at, starts)              # first solid byte of each word
    length = np.diff(np.append(begin, len(at)))
    pos = np.arange(len(at), dtype=np.int64) - np.repeat(begin, length)
    power = np.cumprod(np.full(int(length.max()), _P, dtype=np.uint64))
    value = _BYTE[_LOWER[data[at]]] * power[pos]
    del pos, at
    h = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * _Q)
    row_first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(row_first))
    return h, row, row_first


def ngrams(h: np.ndarray, row_first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs and the first run index per row. A row with
    fewer than k words, but at least one, gives its whole sequence as one run."""
    counts = np.diff(row_first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    start = row_first[:-1][row] + np.arange(out_first[-1]) - out_first[:-1][row]
    acc = np.zeros(len(start), dtype=np.uint64)
    size = np.minimum(counts, k)[row]
    for i in range(k):
        live = i < size
        if live.all():
            acc = acc * _Q + h[start + i]
        else:
            acc[live] = acc[live] * _Q + h[start[live] + i]
    return mix(acc + size.astype(np.uint64)), out_first


def distinct_per_row(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of every row."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        v = np.sort(values[a:b])
        if b - a > 1:
            keep = np.empty(b - a, dtype=bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        out.append(v)
    return out
