"""Detectors: a scorer and a threshold, fitted one after the other."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tidewatch.operators.component import BaseDetector, BaseScorer, BaseThreshold
from tidewatch.operators.scoring import AutoregressionResidualScorer, DoubleRollingScorer, MinClusterScorer, OutlierScorer, PcaReconstructionErrorScorer, RegressionResidualScorer, SeasonalResidualScorer
from tidewatch.operators.thresholds import EsdThreshold, FixedThreshold, IqrThreshold, QuantileThreshold
from tidewatch.sources.series import Series

SIDES = ("both", "positive", "negative")


def check_side(side: str) -> str:
    if side not in SIDES:
        raise ValueError(f"side is one of {', '.join(SIDES)}")
    return side


class ScoreDetector(BaseDetector):
    """Any scorer (None: the values themselves) and any threshold.  Parts are built anew at every fit."""

    def __init__(self, scorer: BaseScorer | None, threshold: BaseThreshold):
        self.scorer, self.threshold = scorer, threshold

    def _build(self) -> tuple[BaseScorer | None, BaseThreshold]:
        return self.scorer.clone() if self.scorer is not None else None, self.threshold.clone()

    @property
    def fitted(self) -> bool:
        return not self.trainable or getattr(self, "threshold_", None) is not None

    def _sized(self, scores: Series) -> Series:
        return scores

    def _labels(self, labels: Series, scores: Series) -> Series:
        return labels

    def _learn(self, series: Series) -> None:
        self.scorer_, self.threshold_ = self._build()
        scores = series if self.scorer_ is None else self.scorer_.fit_run(series)
        self.threshold_.fit(self._sized(scores))

    def scores(self, data: Any) -> Series:
        series = Series.of(data)
        return series if self.scorer_ is None else self.scorer_.run(series)

    def _compute(self, series: Series) -> Series:
        if not hasattr(self, "threshold_"):  # nothing to learn
            self.scorer_, self.threshold_ = self._build()
        scores = self.scores(series)
        return self._labels(self.threshold_.run(self._sized(scores)), scores)


class SignedScoreDetector(ScoreDetector):
    """The threshold sees sizes of scores; labels of the wrong sign are cleared."""

    def __init__(self, scorer: BaseScorer | None, threshold: BaseThreshold, side: str = "both"):
        super().__init__(scorer, threshold)
        self.side = check_side(side)

    def _sized(self, scores: Series) -> Series:
        return scores.with_values({c: F.abs(c) for c in scores.values})

    def _compute(self, series: Series) -> Series:
        if not hasattr(self, "threshold_"):
            self.scorer_, self.threshold_ = self._build()
        side = check_side(self.side)
        scores = self.scores(series)
        if side == "both":
            return self.threshold_.run(self._sized(scores))
        # sign and size in one projection, so that labels need no join back to the scores
        signs = tuple(f"__s_{c}" for c in scores.values)
        wide = scores.with_values({**{f"__s_{c}": F.col(c) for c in scores.values}, **{c: F.abs(c) for c in scores.values}})
        labels = self.threshold_.run(Series(wide.df, scores.values, scores.keys, signs))
        right = {c: F.col(f"__s_{c}") > 0 if side == "positive" else F.col(f"__s_{c}") < 0 for c in scores.values}
        return scores.with_values({c: F.when(F.col(c) == 1.0, F.when(right[c], 1.0).otherwise(0.0)).otherwise(F.col(c)) for c in scores.values}, labels.df)


class ThresholdDetector(ScoreDetector):
    trainable = False

    def __init__(self, low: float | None = None, high: float | None = None):
        self.low, self.high = low, high

    def _build(self) -> tuple:
        return None, FixedThreshold(self.low, self.high)


class QuantileDetector(ScoreDetector):
    def __init__(self, low: float | None = None, high: float | None = None):
        self.low, self.high = low, high

    def _build(self) -> tuple:
        return None, QuantileThreshold(self.low, self.high)


class IqrDetector(ScoreDetector):
    def __init__(self, factor: Any = 3.0):
        self.factor = factor

    def _build(self) -> tuple:
        return None, IqrThreshold(self.factor)


class EsdDetector(ScoreDetector):
    def __init__(self, alpha: float = 0.05):
        self.alpha = alpha

    def _build(self) -> tuple:
        return None, EsdThreshold(self.alpha)


class SpikeDetector(SignedScoreDetector):
    """A value against the window before it."""

    def __init__(self, window: Any = 1, factor: float | None = 3.0, side: str = "both", min_periods: int | None = None, agg: str = "median"):
        self.window, self.factor, self.side, self.min_periods, self.agg = window, factor, check_side(side), min_periods, agg
        if agg not in ("median", "mean"):
            raise ValueError("agg is median or mean")

    def _build(self) -> tuple:
        return DoubleRollingScorer((self.window, 1), self.agg, "diff", (self.min_periods, 1)), IqrThreshold((None, self.factor))


class LevelShiftDetector(SignedScoreDetector):
    """Medians of adjacent windows."""

    def __init__(self, window: Any, factor: float | None = 6.0, side: str = "both", min_periods: Any = None):
        self.window, self.factor, self.side, self.min_periods = window, factor, check_side(side), min_periods

    def _build(self) -> tuple:
        return DoubleRollingScorer(self.window, "median", "diff", self.min_periods), IqrThreshold((None, self.factor))


class VolatilityShiftDetector(SignedScoreDetector):
    """Spreads of adjacent windows, relatively."""

    def __init__(self, window: Any, factor: float | None = 6.0, side: str = "both", min_periods: Any = None, agg: str = "std"):
        self.window, self.factor, self.side, self.min_periods, self.agg = window, factor, check_side(side), min_periods, agg
        if agg not in ("std", "var", "iqr", "idr"):
            raise ValueError("agg is std, var, iqr or idr")

    def _build(self) -> tuple:
        return DoubleRollingScorer(self.window, self.agg, "rel_diff", self.min_periods), IqrThreshold((None, self.factor))


class SeasonalDetector(SignedScoreDetector):
    def __init__(self, period: int | None = None, factor: float | None = 3.0, side: str = "both", trend: bool = False):
        self.period, self.factor, self.side, self.trend = period, factor, check_side(side), trend

    def _build(self) -> tuple:
        return SeasonalResidualScorer(self.period, self.trend), IqrThreshold((None, self.factor))


class AutoregressionDetector(SignedScoreDetector):
    def __init__(self, n_steps: int = 1, step_size: int = 1, regressor: Any = None, factor: float | None = 3.0, side: str = "both"):
        self.n_steps, self.step_size, self.regressor, self.factor, self.side = n_steps, step_size, regressor, factor, check_side(side)

    def _build(self) -> tuple:
        return AutoregressionResidualScorer(self.n_steps, self.step_size, self.regressor), IqrThreshold((None, self.factor))


class OneLabel:
    """Detectors over all columns give one label, ``anomaly``."""

    multivariate = True

    def _compute(self, series: Series) -> Series:
        out = super()._compute(series)
        return out.rename({out.values[0]: "anomaly"})


class MultivariateScoreDetector(OneLabel, ScoreDetector):
    pass


class MultivariateSignedScoreDetector(OneLabel, SignedScoreDetector):
    pass


class RegressionDetector(MultivariateSignedScoreDetector):
    def __init__(self, target: str, regressor: Any = None, factor: float | None = 3.0, side: str = "both"):
        self.target, self.regressor, self.factor, self.side = target, regressor, factor, check_side(side)

    def _build(self) -> tuple:
        return RegressionResidualScorer(self.target, self.regressor), IqrThreshold((None, self.factor))


class PcaDetector(MultivariateScoreDetector):
    def __init__(self, k: int = 1, factor: float | None = 5.0):
        self.k, self.factor = k, factor

    def _build(self) -> tuple:
        return PcaReconstructionErrorScorer(self.k), IqrThreshold((None, self.factor))


class MinClusterDetector(MultivariateScoreDetector):
    def __init__(self, model: Any):
        self.model = model

    def _build(self) -> tuple:
        return MinClusterScorer(self.model), FixedThreshold(high=0.5)


class OutlierDetector(MultivariateScoreDetector):
    def __init__(self, model: Any):
        self.model = model

    def _build(self) -> tuple:
        return OutlierScorer(self.model), FixedThreshold(high=0.5)

