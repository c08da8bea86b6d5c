"""Rolling windows as Spark window frames.

A window is a number of rows or a duration.  Time is a BIGINT of nanoseconds, so open and closed ends of a duration are
exact integers and need no rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.durations import Window, parse_duration

CLOSED = ("right", "left", "both", "neither")
AGGREGATIONS = ("count", "nnz", "nunique", "sum", "mean", "min", "max", "median", "var", "std", "quantile", "iqr", "idr", "skew", "kurt")
DIFFS = ("l1", "l2", "diff", "rel_diff", "abs_rel_diff")
INFINITY = float("inf")


@dataclass(frozen=True)
class Frame:
    """Bounds of a window around a row: in rows, or in nanoseconds."""

    rows: bool
    low: int
    high: int

    def over(self, ordered: WindowSpec) -> WindowSpec:
        return ordered.rowsBetween(self.low, self.high) if self.rows else ordered.rangeBetween(self.low, self.high)


def size_of(window: Window) -> tuple[bool, int]:
    """Whether the window counts rows, and its size."""
    if isinstance(window, bool):
        raise TypeError("a window is a number of rows or a duration")
    if isinstance(window, int):
        if window < 1:
            raise ValueError("a window has one row at least")
        return True, window
    size = parse_duration(window)
    if size < 1:
        raise ValueError("a window's duration is positive")
    return False, size


def window_bounds(window: Window, *, center: bool = False, closed: str | None = None, forward: bool = False) -> Frame:
    """The frame of a trailing, centred or forward window.

    Rows: ``closed`` moves the ends of the default ``right`` (the row and those before it).  Durations: trailing windows
    span (t - S, t] by default; centred ones (t - S // 2, t + S // 2] whatever ``closed`` says; forward ones [t, t + S).
    """
    closed = closed or "right"
    if closed not in CLOSED:
        raise ValueError(f"closed is one of {', '.join(CLOSED)}")
    rows, size = size_of(window)
    if forward:
        return Frame(rows, 0, size - 1)
    if not rows and center:
        half = size // 2
        return Frame(False, -(half - 1), half)
    shift = (size - 1) // 2 if rows and center else 0
    low, high = shift - size + 1, shift
    return Frame(rows, low - (closed in ("left", "both")), high - (closed in ("left", "neither")))


def default_min_periods(window: Window, closed: str | None = None) -> int:
    rows, size = size_of(window)
    if not rows:
        return 1
    return size + 1 if closed == "both" else max(size - 1, 1) if closed == "neither" else size


def check_agg(agg: str, q: Any) -> None:
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}; there are {', '.join(AGGREGATIONS)}")
    if agg == "quantile":
        for x in q if isinstance(q, Sequence) else [q]:
            if x is None or not 0 <= x <= 1:
                raise ValueError("quantile needs q between 0 and 1")


def aggregate(v: Column, agg: str, w: WindowSpec, *, min_periods: int = 1, q: float | None = None) -> Column:
    """``agg`` of the present values of ``v`` in the frame ``w``; null where fewer than ``min_periods`` are present."""
    check_agg(agg, q)
    n = F.count(v).over(w)
    two = lambda a, b: F.percentile(v, F.array(F.lit(a), F.lit(b))).over(w)
    if agg == "count":
        out = n.cast("double")
    elif agg == "nnz":
        out = F.sum((v != 0).cast("double")).over(w)
    elif agg == "nunique":
        out = F.size(F.collect_set(v).over(w)).cast("double")
    elif agg in ("median", "quantile"):
        out = F.percentile(v, F.lit(0.5 if agg == "median" else float(q))).over(w)
    elif agg in ("iqr", "idr"):
        both = two(0.25, 0.75) if agg == "iqr" else two(0.1, 0.9)
        out = F.element_at(both, 2) - F.element_at(both, 1)
    elif agg == "skew":
        g = F.when(n >= 3, F.skewness(v).over(w))
        out = F.when(F.min(v).over(w) < F.max(v).over(w), g * F.sqrt(n * (n - 1.0)) / F.when(n >= 3, n - 2.0))
    elif agg == "kurt":
        e = F.when(n >= 4, F.kurtosis(v).over(w))
        m = F.when(n >= 4, (n - 2.0) * (n - 3.0))
        out = F.when(F.min(v).over(w) < F.max(v).over(w), ((n * n - 1.0) * (e + 3.0) - 3.0 * (n - 1.0) * (n - 1.0)) / m)
    else:
        function = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}[agg]
        out = function(v).over(w)
    return F.when(n >= max(min_periods, 1), out)


def rolling(v: Column, ordered: WindowSpec, window: Window, agg: str = "mean", *, center: bool = False, min_periods: int | None = None, closed: str | None = None, q: float | None = None) -> Column:
    """Rolling aggregation of a column over its series' order."""
    least = default_min_periods(window, closed) if min_periods is None else min_periods
    return aggregate(v, agg, window_bounds(window, center=center, closed=closed).over(ordered), min_periods=least, q=q)


def pair(x: Any) -> tuple[Any, Any]:
    return x if isinstance(x, tuple) else (x, x)


def double_rolling(v: Column, ordered: WindowSpec, window: Any, agg: Any = "median", *, diff: str = "l1", min_periods: Any = None, q: Any = None) -> Column:
    """Difference between the window that begins at a row and the one strictly before it.

    ``window``, ``agg``, ``min_periods`` and ``q`` may be (left, right) pairs.
    """
    if diff not in DIFFS:
        raise ValueError(f"unknown difference {diff!r}; there are {', '.join(DIFFS)}")
    (lw, rw), (la, ra), (lm, rm), (lq, rq) = pair(window), pair(agg), pair(min_periods), pair(q)
    rows, size = size_of(lw)
    left = Frame(rows, -size, -1).over(ordered)
    right = window_bounds(rw, forward=True).over(ordered)
    a = aggregate(v, la, left, min_periods=default_min_periods(lw) if lm is None else lm, q=lq)
    b = aggregate(v, ra, right, min_periods=default_min_periods(rw) if rm is None else rm, q=rq)
    return difference(a, b, diff)


def difference(a: Column, b: Column, diff: str) -> Column:
    """``b`` against ``a``; relative differences to zero are infinite, and unknown where both are zero."""
    if diff in ("l1", "l2"):
        return F.abs(b - a)
    if diff == "diff":
        return b - a
    relative = F.when(a == 0, F.when(b > 0, F.lit(INFINITY)).when(b < 0, F.lit(-INFINITY))).otherwise((b - a) / F.when(a != 0, a))
    return relative if diff == "rel_diff" else F.abs(relative)
