"""Further method families, each a scorer and a detector."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import kernels
from tidewatch.functions.window import aggregate, default_min_periods, size_of, window_bounds
from tidewatch.operators.component import BaseScorer
from tidewatch.operators.detection import ScoreDetector
from tidewatch.operators.thresholds import FixedThreshold, IqrThreshold
from tidewatch.sources.series import TIME, Series

DAY = 86_400 * 10**9


class HampelScorer(BaseScorer):
    """Distance from the rolling median in units of the window's scaled median absolute deviation (of the points'
    distances from their own medians).  Unknown where the spread is zero."""

    trainable = False

    def __init__(self, window: Any = 7, center: bool = True):
        self.window, self.center = window, center

    def _compute(self, series: Series) -> Series:
        w = window_bounds(self.window, center=self.center).over(series.ordered)
        least = default_min_periods(self.window)
        away = series.with_values({c: F.abs(F.col(c) - aggregate(F.col(c), "median", w, min_periods=least)) for c in series.values})

        def score(c: str) -> Column:
            spread = aggregate(F.col(c), "median", w, min_periods=1) * kernels.MAD_SCALE
            return F.when(spread > 0, F.col(c) / F.when(spread > 0, spread))

        return away.with_values({c: score(c) for c in away.values})


class RollingQuantileScorer(BaseScorer):
    """How far a value stands outside the band of its window's quantiles."""

    trainable = False

    def __init__(self, window: Any, low: float = 0.05, high: float = 0.95):
        self.window, self.low, self.high = window, low, high
        if not 0 <= low < high <= 1:
            raise ValueError("quantiles rise from 0 to 1")

    def _compute(self, series: Series) -> Series:
        w = window_bounds(self.window).over(series.ordered)
        least = default_min_periods(self.window)

        def score(c: str) -> Column:
            v = F.col(c)
            q = F.percentile(v, F.array(F.lit(float(self.low)), F.lit(float(self.high)))).over(w)
            out = F.greatest(v - F.element_at(q, 2), F.element_at(q, 1) - v, F.lit(0.0))
            return F.when(v.isNotNull() & (F.count(v).over(w) >= least), out)

        return series.with_values({c: score(c) for c in series.values})


class KernelScorer(BaseScorer):
    """A scorer whose result needs the whole series in order: one task per series, all columns together."""

    trainable = False

    def _kernel(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _check(self, series: Series) -> None:
        return None

    def _compute(self, series: Series) -> Series:
        self._check(series)
        kernel = self._kernel

        def run(t: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            return {c: kernel(t, x) for c, x in columns.items()}

        return series.per_series(run, series.values)


def with_gaps(x: np.ndarray, function: Any) -> np.ndarray:
    """Apply to the series with its gaps bridged; unknown where the value was."""
    if np.isnan(x).all():
        return np.full(len(x), np.nan)
    return np.where(np.isnan(x), np.nan, function(kernels.filled(x)))


class SpectralResidualScorer(KernelScorer):
    def __init__(self, window: int = 3, series_window: int = 21, score_window: int = 21):
        self.window, self.series_window, self.score_window = window, series_window, score_window

    def _check(self, series: Series) -> None:
        series.required_freq("SpectralResidualScorer")

    def _kernel(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return with_gaps(x, lambda y: kernels.spectral_residual(y, self.window, self.series_window, self.score_window))


class MatrixProfileScorer(KernelScorer):
    """Distance to the nearest other subsequence; a point gets the largest of those that cover it."""

    left = False

    def __init__(self, window: int, normalize: bool = True):
        self.window, self.normalize = window, normalize
        if not isinstance(window, int) or window < 3:
            raise ValueError("the window has three rows at least")

    def _kernel(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        m = self.window
        if len(x) < 2 * m:
            raise ValueError(f"{len(x)} rows are too few for subsequences of {m}")

        def run(y: np.ndarray) -> np.ndarray:
            d = kernels.nearest_distances(y, m, self.normalize, self.left)
            if self.left:
                d[: 2 * m] = np.inf
            return kernels.covering_max(d, len(y), m)

        return with_gaps(x, run)


class DampScorer(MatrixProfileScorer):
    """The same against the past only: nearest subsequence that ended before; the first ones are unknown."""

    left = True


def default_period(freq: int) -> int:
    """A day of rows where the step divides one, a week of daily ones."""
    if freq < DAY and DAY % freq == 0:
        return DAY // freq
    if freq == DAY:
        return 7
    raise ValueError("no period goes without saying for this step; name one")


class StlResidualScorer(KernelScorer):
    """Size of the remainder of a seasonal-trend decomposition by loess."""

    def __init__(self, period: int | None = None, robust: bool = True, seasonal: int | None = None):
        self.period, self.robust, self.seasonal = period, robust, seasonal

    def _compute(self, series: Series) -> Series:
        freq = series.required_freq("StlResidualScorer")
        self.period_ = default_period(freq) if self.period is None else self.period
        if self.period_ < 2:
            raise ValueError("a period has two rows at least")
        return super()._compute(series)

    def _kernel(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(x) < 2 * self.period_:
            raise ValueError(f"{len(x)} rows are less than two periods")
        return with_gaps(x, lambda y: np.abs(kernels.stl(y, self.period_, self.seasonal or 7, self.robust)[2]))


class MstlResidualScorer(KernelScorer):
    """The same with several seasonal parts."""

    def __init__(self, periods: Any, robust: bool = True, windows: Any = None):
        self.periods, self.robust, self.windows = periods, robust, windows

    def _check(self, series: Series) -> None:
        series.required_freq("MstlResidualScorer")
        if any(p < 2 for p in self.periods):
            raise ValueError("a period has two rows at least")

    def _kernel(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        periods = sorted(int(p) for p in self.periods)
        if len(x) < 2 * periods[-1]:
            raise ValueError(f"{len(x)} rows are less than two of the longest period")
        windows = list(self.windows) if self.windows is not None else [7 + 4 * (i + 1) for i in range(len(periods))]
        return with_gaps(x, lambda y: np.abs(kernels.mstl(y, periods, windows, self.robust)))


class BreakpointScorer(BaseScorer):
    """Size of the level change at the times where the training series changes, 0 elsewhere, told by exact time."""

    def _segment(self, x: np.ndarray) -> list[int]:
        raise NotImplementedError

    def _learn(self, series: Series) -> None:
        segment = self._segment

        def run(t: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            out = {}
            for c, x in columns.items():
                ok = ~np.isnan(x)
                out[c] = kernels.change_sizes(x, segment(kernels.filled(x))) if ok.any() else np.zeros(len(x))
            return out

        sizes = series.per_series(run, series.values)
        told = sizes.df.where(" OR ".join(f"`{c}` <> 0" for c in sizes.values))
        self.changes_ = told.persist() if series.keys else [tuple(r) for r in told.orderBy(TIME).collect()]
        self.schema_ = told.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    @property
    def breakpoints_(self) -> Any:
        """Times of the changes, per column."""
        if not isinstance(self.changes_, list):
            return self.changes_
        return {c: [r[0] for r in self.changes_ if r[1 + i]] for i, c in enumerate(self.columns_)}

    def _compute(self, series: Series) -> Series:
        told = self.changes_
        if isinstance(told, list):
            told = series.df.sparkSession.createDataFrame(told, f"{TIME} long, " + ", ".join(f"`{c}` double" for c in self.columns_))
        told = told.select(*series.axis, *[F.col(c).alias(f"__b_{c}") for c in series.values])
        df = series.df.join(told, list(series.axis), "left")
        return series.with_values({c: F.when(F.col(c).isNotNull(), F.coalesce(f"__b_{c}", F.lit(0.0))) for c in series.values}, df)


class PeltScorer(BreakpointScorer):
    """Exact penalised segmentation."""

    def __init__(self, penalty: float | None = None, cost: str = "l2", min_size: int = 2, jump: int = 1):
        self.penalty, self.cost, self.min_size, self.jump = penalty, cost, min_size, jump
        if cost not in ("l1", "l2"):
            raise ValueError("cost is l1 or l2")

    def _segment(self, x: np.ndarray) -> list[int]:
        return kernels.pelt(x, self.cost, self.penalty, self.min_size, self.jump)


class RupturesScorer(BreakpointScorer):
    """Other searches: binary segmentation, sliding window, dynamic programming, bottom-up."""

    def __init__(self, model: str = "binseg", cost: str = "l2", penalty: float | None = None, n_bkps: int | None = None):
        self.model, self.cost, self.penalty, self.n_bkps = model, cost, penalty, n_bkps
        if model not in ("binseg", "window", "dynp", "bottomup"):
            raise ValueError("model is binseg, window, dynp or bottomup")
        if cost not in ("l1", "l2"):
            raise ValueError("cost is l1 or l2")

    def _segment(self, x: np.ndarray) -> list[int]:
        return kernels.search_changes(x, self.model, self.cost, self.penalty, self.n_bkps)


class HampelDetector(ScoreDetector):
    trainable = False

    def __init__(self, window: Any = 7, factor: float = 3.0, center: bool = True):
        self.window, self.factor, self.center = window, factor, center

    def _build(self) -> tuple:
        return HampelScorer(self.window, self.center), FixedThreshold(high=self.factor)


class RollingQuantileDetector(ScoreDetector):
    def __init__(self, window: Any, low: float = 0.05, high: float = 0.95, factor: float | None = 3.0):
        self.window, self.low, self.high, self.factor = window, low, high, factor

    def _build(self) -> tuple:
        return RollingQuantileScorer(self.window, self.low, self.high), IqrThreshold((None, self.factor))


class SpectralResidualDetector(ScoreDetector):
    def __init__(self, window: int = 3, series_window: int = 21, score_window: int = 21, factor: float | None = 3.0):
        self.window, self.series_window, self.score_window, self.factor = window, series_window, score_window, factor

    def _build(self) -> tuple:
        return SpectralResidualScorer(self.window, self.series_window, self.score_window), IqrThreshold((None, self.factor))


class PeltDetector(ScoreDetector):
    def __init__(self, penalty: float | None = None, cost: str = "l2", min_size: int = 2, jump: int = 1):
        self.penalty, self.cost, self.min_size, self.jump = penalty, cost, min_size, jump

    def _build(self) -> tuple:
        return PeltScorer(self.penalty, self.cost, self.min_size, self.jump), FixedThreshold(high=0.0)


class RupturesDetector(ScoreDetector):
    def __init__(self, model: str = "binseg", cost: str = "l2", penalty: float | None = None, n_bkps: int | None = None):
        self.model, self.cost, self.penalty, self.n_bkps = model, cost, penalty, n_bkps

    def _build(self) -> tuple:
        return RupturesScorer(self.model, self.cost, self.penalty, self.n_bkps), FixedThreshold(high=0.0)


class MatrixProfileDetector(ScoreDetector):
    def __init__(self, window: int, factor: float | None = 3.0, normalize: bool = True):
        self.window, self.factor, self.normalize = window, factor, normalize

    def _build(self) -> tuple:
        return MatrixProfileScorer(self.window, self.normalize), IqrThreshold((None, self.factor))


class DampDetector(ScoreDetector):
    def __init__(self, window: int, factor: float | None = 3.0, normalize: bool = True):
        self.window, self.factor, self.normalize = window, factor, normalize

    def _build(self) -> tuple:
        return DampScorer(self.window, self.normalize), IqrThreshold((None, self.factor))


class StlDetector(ScoreDetector):
    def __init__(self, period: int | None = None, robust: bool = True, seasonal: int | None = None, factor: float | None = 3.0):
        self.period, self.robust, self.seasonal, self.factor = period, robust, seasonal, factor

    def _build(self) -> tuple:
        return StlResidualScorer(self.period, self.robust, self.seasonal), IqrThreshold((None, self.factor))


class MstlDetector(ScoreDetector):
    def __init__(self, periods: Any, robust: bool = True, windows: Any = None, factor: float | None = 3.0):
        self.periods, self.robust, self.windows, self.factor = periods, robust, windows, factor

    def _build(self) -> tuple:
        return MstlResidualScorer(self.periods, self.robust, self.windows), IqrThreshold((None, self.factor))


__all__ = [n for n in dir() if n.endswith(("Scorer", "Detector"))] + ["size_of"]
