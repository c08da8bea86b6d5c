"""Scorers."""

from __future__ import annotations

import copy
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.kernels import MAD_SCALE
from tidewatch.functions.window import double_rolling, rolling
from tidewatch.operators.component import Attached, BaseScorer, BaseTransformer, learn
from tidewatch.operators.features import OrdinaryLeastSquares, PcaReconstructionError, RegressionResidual, SeasonalDecomposition, moments
from tidewatch.sources.series import Series

INFINITY = float("inf")


class RollingAggregateScorer(BaseScorer):
    """A rolling statistic as a score."""

    trainable = False

    def __init__(self, window: Any, agg: str = "mean", center: bool = False, min_periods: int | None = None, closed: str | None = None, q: float | None = None):
        self.window, self.agg, self.center, self.min_periods, self.closed, self.q = window, agg, center, min_periods, closed, q

    def _compute(self, series: Series) -> Series:
        return series.with_values({c: rolling(F.col(c), series.ordered, self.window, self.agg, center=self.center, min_periods=self.min_periods, closed=self.closed, q=self.q) for c in series.values})


class DoubleRollingScorer(BaseScorer):
    """Difference of two adjacent windows, told at their boundary."""

    trainable = False

    def __init__(self, window: Any, agg: Any = "median", diff: str = "l1", min_periods: Any = None, q: Any = None):
        self.window, self.agg, self.diff, self.min_periods, self.q = window, agg, diff, min_periods, q

    def _compute(self, series: Series) -> Series:
        return series.with_values({c: double_rolling(F.col(c), series.ordered, self.window, self.agg, diff=self.diff, min_periods=self.min_periods, q=self.q) for c in series.values})


class DeviationScorer(BaseScorer):
    """Signed distance from the centre, in units of the spread; both learned."""

    def __init__(self, center: str = "median", scale: str = "iqr"):
        self.center, self.scale = center, scale
        if center not in ("median", "mean") or scale not in ("iqr", "idr", "mad", "std"):
            raise ValueError("center is median or mean; scale is iqr, idr, mad or std")

    def _learn(self, series: Series) -> None:
        def spread(c: str) -> Column:
            if self.scale == "std":
                return F.stddev_samp(c)
            a, b = (0.25, 0.75) if self.scale == "iqr" else (0.1, 0.9)
            q = F.percentile(c, F.array(F.lit(a), F.lit(b)))
            return F.element_at(q, 2) - F.element_at(q, 1)

        middle = {c: F.percentile(c, F.lit(0.5)) if self.center == "median" else F.avg(c) for c in series.values}
        if self.scale != "mad":
            self.model_ = learn(series, {c: {"center": middle[c], "scale": spread(c)} for c in series.values})
            return
        medians = learn(series, {c: {"median": F.percentile(c, F.lit(0.5))} for c in series.values})
        at = Attached(series, medians)
        away = {c: F.percentile(F.abs(F.col(c) - at(c, "median")), F.lit(0.5)) * MAD_SCALE for c in series.values}
        self.model_ = learn(series, {c: {"center": middle[c], "scale": away[c]} for c in series.values}, at.df)

    def _compute(self, series: Series) -> Series:
        at = Attached(series, self.model_)

        def score(c: str) -> Column:
            off, scale = F.col(c) - at(c, "center"), at(c, "scale")
            flat = F.when(off > 0, INFINITY).when(off < 0, -INFINITY).when(off == 0, 0.0)
            return F.when(scale == 0, flat).otherwise(off / F.when(scale != 0, scale))

        return series.with_values({c: score(c) for c in series.values}, at.df)


class TransformerScorer(BaseScorer):
    """Scores are what a transformer gives; without a complete training row all are unknown."""

    def _transformer(self) -> BaseTransformer:
        raise NotImplementedError

    def _learn(self, series: Series) -> None:
        self.transformer_ = self._transformer()
        if not series.complete_rows().df.take(1):
            self.transformer_ = None
            return
        self.transformer_.fit(series)

    def _compute(self, series: Series) -> Series:
        if self.transformer_ is None:
            names = series.values if not self.multivariate else ("score",)
            return series.with_values({c: F.lit(None).cast("double") for c in names})
        return self.transformer_.run(series)


class SeasonalResidualScorer(TransformerScorer):
    def __init__(self, period: int | None = None, trend: bool = False):
        self.period, self.trend = period, trend

    def _transformer(self) -> BaseTransformer:
        return SeasonalDecomposition(self.period, self.trend)

    @property
    def period_(self) -> Any:
        return self.transformer_.period_

    @property
    def seasonal_(self) -> Any:
        return self.transformer_.seasonal_


class RegressionResidualScorer(TransformerScorer):
    multivariate = True

    def __init__(self, target: str, regressor: Any = None):
        self.target, self.regressor = target, regressor

    def _transformer(self) -> BaseTransformer:
        return RegressionResidual(self.target, copy.deepcopy(self.regressor))


class PcaReconstructionErrorScorer(TransformerScorer):
    multivariate = True

    def __init__(self, k: int = 1):
        self.k = k

    def _transformer(self) -> BaseTransformer:
        return PcaReconstructionError(self.k)

    @property
    def mean_(self) -> np.ndarray:
        return self.transformer_.mean_

    @property
    def components_(self) -> np.ndarray:
        return self.transformer_.components_


class AutoregressionResidualScorer(BaseScorer):
    """What a regression on a value's own past leaves."""

    def __init__(self, n_steps: int = 1, step_size: int = 1, regressor: Any = None):
        self.n_steps, self.step_size, self.regressor = n_steps, step_size, regressor
        if n_steps < 1 or step_size < 1:
            raise ValueError("steps are positive")

    def _lagged(self, series: Series, c: str) -> Series:
        return series.with_values({"y": F.col(c), **{f"x{i}": F.lag(c, (i + 1) * self.step_size).over(series.ordered) for i in range(self.n_steps)}})

    def _learn(self, series: Series) -> None:
        series.required_freq("AutoregressionResidualScorer")
        if series.keys:
            raise ValueError("regressions are fitted on one series")
        self.models_ = {}
        for c in series.values:
            lagged = self._lagged(series, c)
            if self.regressor is None:
                mean, gram, n = moments(lagged, lagged.values)
                self.models_[c] = OrdinaryLeastSquares.of_moments(mean[1:], mean[0], gram[1:, 1:], gram[1:, 0]) if n else None
            else:
                residual = RegressionResidual("y", self.regressor)
                self.models_[c] = residual.fit(lagged).regressor_ if lagged.complete_rows().df.take(1) else None

    def _compute(self, series: Series) -> Series:
        series.required_freq("AutoregressionResidualScorer")
        out, rest = {}, []
        for c in series.values:
            m = self.models_[c]
            if m is None:
                out[c] = F.lit(None).cast("double")
            elif isinstance(m, OrdinaryLeastSquares):
                fitted = F.lit(m.intercept_)
                for i, w in enumerate(m.coefficients_):
                    fitted = fitted + F.lit(float(w)) * F.lag(c, (i + 1) * self.step_size).over(series.ordered)
                out[c] = F.col(c) - fitted
            else:
                residual = RegressionResidual("y", self.regressor)
                residual.columns_, residual.regressor_ = ("y", *[f"x{i}" for i in range(self.n_steps)]), m
                rest.append(residual.run(self._lagged(series, c)).rename({"residual": c}))
        if not rest:
            return series.with_values(out)
        joined = (series.with_values(out), *rest) if out else tuple(rest)
        return joined[0].join(*joined[1:]).select(*series.values)


def predictor(model: Any, names: tuple[str, ...]) -> Any:
    """A column of the model's predictions on complete rows; null elsewhere."""

    @F.pandas_udf("double")
    def predicted(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        ok, out = ~np.isnan(x).any(axis=1), np.full(len(x), np.nan)
        if ok.any():
            out[ok] = np.asarray(model.predict(x[ok]), float)
        return pd.Series(out)

    p = predicted(*[F.col(c) for c in names])
    return F.when(~F.isnan(p), p)


class MinClusterScorer(BaseScorer):
    """1 for rows of the cluster that is rarest in training.

    ``model`` has ``fit(X)`` and ``predict(X)`` on arrays, or is an estimator of ``pyspark.ml.clustering``, which then
    runs distributed."""

    multivariate = True

    def __init__(self, model: Any):
        self.model = model

    @staticmethod
    def _vectors(series: Series) -> Any:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=list(series.values), outputCol="features").transform(series.complete_rows().df)

    def _learn(self, series: Series) -> None:
        from pyspark.ml import Estimator

        if isinstance(self.model, Estimator):
            rows = self._vectors(series)
            self.fitted_ = self.model.fit(rows)
            labels = self.fitted_.transform(rows).select(F.col(self.fitted_.getPredictionCol()).cast("double").alias("p"))
        else:
            if not callable(getattr(self.model, "predict", None)):
                raise TypeError("the model needs predict")
            whole = series.complete_rows()
            self.fitted_ = copy.deepcopy(self.model)
            self.fitted_.fit(whole.df.select(*series.values).toPandas().to_numpy(float))  # a model of the user's fits in memory
            labels = whole.df.select(predictor(self.fitted_, series.values).alias("p"))
        counts = [tuple(r) for r in labels.groupBy("p").count().orderBy("count", "p").limit(2).collect()]
        self.rarest_ = counts[0][0] if len(counts) > 1 else None

    def _compute(self, series: Series) -> Series:
        from pyspark.ml import Model

        if isinstance(self.fitted_, Model):
            labelled = self.fitted_.transform(self._vectors(series)).select(*series.axis, F.col(self.fitted_.getPredictionCol()).cast("double").alias("__p"))
            df, p = series.df.join(labelled, list(series.axis), "left"), F.col("__p")
        else:
            df, p = series.df, predictor(self.fitted_, series.values)
        rare = F.lit(0.0) if self.rarest_ is None else F.when(p == self.rarest_, 1.0).otherwise(0.0)
        return series.with_values({"min_cluster": F.when(p.isNotNull(), rare)}, df)


class OutlierScorer(BaseScorer):
    """1 where a model's ``predict`` says -1; one with only ``fit_predict`` sees all rows in one task."""

    multivariate = True

    def __init__(self, model: Any):
        self.model = model

    def _learn(self, series: Series) -> None:
        self.fitted_ = copy.deepcopy(self.model)
        if callable(getattr(self.model, "predict", None)):
            self.fitted_.fit(series.complete_rows().df.select(*series.values).toPandas().to_numpy(float))

    def _compute(self, series: Series) -> Series:
        if callable(getattr(self.fitted_, "predict", None)):
            p = predictor(self.fitted_, series.values)
            return series.with_values({"outlier": F.when(p.isNotNull(), F.when(p == -1, 1.0).otherwise(0.0))})
        model, names = self.fitted_, series.values

        def run(_: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            x = np.column_stack([columns[c] for c in names])
            ok, out = ~np.isnan(x).any(axis=1), np.full(len(x), math.nan)
            if ok.any():
                out[ok] = np.asarray(model.fit_predict(x[ok])) == -1
            return {"outlier": out}

        return series.per_series(run, ["outlier"])
