"""Band and bin assignment (F26, F27, A21–A23) as column expressions.

Statistics that a bin rule needs (min, max) come in as columns, usually
scalar subqueries, so the data is never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Driver-experience bands (years, right-closed; 0 is outside).
EXPERIENCE_EDGES = (0, 2, 5, 10, 20, 30, 100)
EXPERIENCE_LABELS = ("0-2yr", "3-5yr", "6-10yr", "11-20yr", "21-30yr", "30+yr")

# Low edge of an equal-width cut is widened by this share of the range.
CUT_LOW_EDGE_WIDEN = 0.001


def right_closed_band(col: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None,
                      as_index: bool = False) -> Column:
    """label j when edges[j] < c <= edges[j+1]; outside -> NULL."""
    if labels is None:
        labels = [f"({edges[j]}, {edges[j + 1]}]" for j in range(len(edges) - 1)]
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for j in range(len(edges) - 1):
        cond = (c > F.lit(edges[j])) & (c <= F.lit(edges[j + 1]))
        val = F.lit(j + 1) if as_index else F.lit(labels[j])
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def equal_width_cut(col: str | Column, lo: Column, hi: Column, k: int) -> Column:
    """right-closed equal-width interval number 1..k over [lo, hi].

    Interval j is (lo + (j-1)w, lo + jw] with w = (hi - lo)/k; the minimum
    itself falls in the first interval (its low edge is widened). A constant
    column gives one interval."""
    c = F.col(col) if isinstance(col, str) else col
    w = (hi - lo) / F.lit(float(k))
    j = F.greatest(F.lit(1), F.ceil((c - lo) / w).cast("int"))
    return F.when(c.isNull(), F.lit(None)).when(hi == lo, F.lit(1)).otherwise(F.least(F.lit(k), j)).cast("int")


def cut_edges(lo: Column, hi: Column, k: int, j: Column) -> tuple[Column, Column]:
    """Lower / upper edge of interval j of ``equal_width_cut`` (low edge widened)."""
    w = (hi - lo) / F.lit(float(k))
    low = F.when(j == 1, lo - (hi - lo) * F.lit(CUT_LOW_EDGE_WIDEN)).otherwise(lo + (j - 1) * w)
    high = F.when(j == k, hi).otherwise(lo + j * w)
    return low, high


def histogram_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Histogram range: a constant column is widened by 0.5 on each side."""
    same = hi == lo
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def histogram_bin(col: str | Column, lo: Column, hi: Column, k: int) -> Column:
    """Left-closed bin 1..k over [lo, hi], last bin closed; outside -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    lo, hi = histogram_range(lo, hi)
    w = (hi - lo) / F.lit(float(k))
    j = F.least(F.lit(k), (F.floor((c - lo) / w) + 1).cast("int"))
    return F.when((c >= lo) & (c <= hi), j)


def fixed_edge_bin(col: str | Column, edges: Sequence[float]) -> Column:
    """Bin over literal edges, left-closed, last bin closed, outside -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    n = len(edges) - 1
    expr = None
    for j in range(n):
        upper_ok = (c <= F.lit(edges[j + 1])) if j == n - 1 else (c < F.lit(edges[j + 1]))
        cond = (c >= F.lit(edges[j])) & upper_ok
        expr = F.when(cond, F.lit(j + 1)) if expr is None else expr.when(cond, F.lit(j + 1))
    return expr


def linspace(start: float, stop: float, num: int) -> list[float]:
    """Evenly spaced edges, computed like numpy (last edge exact)."""
    if num == 1:
        return [float(start)]
    step = (stop - start) / (num - 1)
    out = [start + i * step for i in range(num)]
    out[-1] = float(stop)
    return out
