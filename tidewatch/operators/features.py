"""Transformers."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.durations import parse_duration
from tidewatch.functions.kernels import detect_period
from tidewatch.functions.window import aggregate, check_agg, default_min_periods, double_rolling, pair, rolling, size_of, window_bounds
from tidewatch.operators.component import Attached, BaseTransformer, learn, named
from tidewatch.sources.series import TIME, Series


def edges_of(bins: int | Sequence[float], low: float | None, high: float | None) -> list[float]:
    """Bin edges; a number of bins spans the observed values evenly."""
    if not isinstance(bins, int):
        edges = [float(x) for x in bins]
        if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("bin edges must rise")
        return edges
    if bins < 1:
        raise ValueError("there is one bin at least")
    if low is None or high is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    return np.linspace(low, high, bins + 1).tolist()


class RollingAggregate(BaseTransformer):
    """A rolling aggregation; ``quantile`` with several q and ``hist`` give several columns."""

    trainable = False

    def __init__(self, window: Any, agg: str = "mean", agg_params: dict | None = None, center: bool = False, min_periods: int | None = None, closed: str | None = None):
        self.window, self.agg, self.agg_params, self.center, self.min_periods, self.closed = window, agg, agg_params, center, min_periods, closed

    def _compute(self, series: Series) -> Series:
        params = self.agg_params or {}
        options = {"center": self.center, "min_periods": self.min_periods, "closed": self.closed}
        if self.agg == "hist":
            return self._hist(series, params.get("bins", 10))
        q = params.get("q")
        check_agg(self.agg, q)
        out: dict[str, Column] = {}
        for c in series.values:
            if self.agg == "quantile" and isinstance(q, Sequence):
                out |= named(series, c, {f"q{x}": rolling(F.col(c), series.ordered, self.window, "quantile", q=x, **options) for x in q})
            else:
                out[c] = rolling(F.col(c), series.ordered, self.window, self.agg, q=q, **options)
        return series.with_values(out)

    def _hist(self, series: Series, bins: int | Sequence[float]) -> Series:
        spans = [f(c).alias(f"{c}_{n}") for c in series.values for n, f in (("low", F.min), ("high", F.max))] if isinstance(bins, int) else []
        row = series.df.agg(*spans).first().asDict() if spans else {}
        w = window_bounds(self.window, center=self.center, closed=self.closed).over(series.ordered)
        least = default_min_periods(self.window, self.closed) if self.min_periods is None else self.min_periods
        out: dict[str, Column] = {}
        for c in series.values:
            v, edges = F.col(c), edges_of(bins, row.get(f"{c}_low"), row.get(f"{c}_high"))
            columns = {}
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                last = i == len(edges) - 2
                inside = (v >= a) & ((v <= b) if last else (v < b))
                n = F.count(v).over(w)
                columns[f"[{a:g}, {b:g}{']' if last else ')'}"] = F.when(n >= max(least, 1), F.sum(inside.cast("double")).over(w))
            out |= named(series, c, columns)
        return series.with_values(out)


class DoubleRollingAggregate(BaseTransformer):
    """Difference between two adjacent windows, told at the boundary, or with ``center=False`` at the right one's end."""

    trainable = False

    def __init__(self, window: Any, agg: Any = "mean", agg_params: dict | None = None, center: bool = True, min_periods: Any = None, diff: str = "l1"):
        self.window, self.agg, self.agg_params, self.center, self.min_periods, self.diff = window, agg, agg_params, center, min_periods, diff

    def _compute(self, series: Series) -> Series:
        q = (self.agg_params or {}).get("q")
        if "hist" in pair(self.agg) or isinstance(q, list | tuple):
            raise ValueError("two windows are compared by one number each")
        at = {c: double_rolling(F.col(c), series.ordered, self.window, self.agg, diff=self.diff, min_periods=self.min_periods, q=q) for c in series.values}
        out = series.with_values(at)
        return out if self.center else self._at_end(out)

    def _at_end(self, out: Series) -> Series:
        rows, size = size_of(pair(self.window)[1])
        if rows:
            return out.with_values({c: F.lag(c, size - 1).over(out.ordered) for c in out.values})
        end = F.max(TIME).over(out.ordered.rangeBetween(0, size - 1))
        told = out.df.withColumn("__to", end).groupBy(*out.keys, F.col("__to").alias(TIME))
        told = told.agg(*[F.max_by(F.struct(c), TIME)[c].alias(c) for c in out.values])
        return Series(out.df.select(*out.axis).join(told, list(out.axis), "left"), out.values, out.keys)


class Retrospect(BaseTransformer):
    """A row's own value and those of earlier rows (or later ones, for negative lags) as columns."""

    trainable = False

    def __init__(self, n_steps: int = 1, step_size: int = 1, till: int = 0):
        self.n_steps, self.step_size, self.till = n_steps, step_size, till

    def _compute(self, series: Series) -> Series:
        series.required_freq("Retrospect")
        out: dict[str, Column] = {}
        for c in series.values:
            lags = [self.till + i * self.step_size for i in range(self.n_steps)]
            out |= named(series, c, {f"t-{k}" if k >= 0 else f"t+{-k}": F.lag(c, k).over(series.ordered) for k in lags})
        return series.with_values(out)


class StandardScale(BaseTransformer):
    """Centred and scaled by the statistics of the very series given."""

    trainable = False

    def __init__(self) -> None:
        pass

    def _compute(self, series: Series) -> Series:
        w = series.by_key
        sd = {c: F.stddev_samp(c).over(w) for c in series.values}
        return series.with_values({c: (F.col(c) - F.avg(c).over(w)) / F.when(sd[c] > 0, sd[c]).otherwise(1.0) for c in series.values})


class SumAll(BaseTransformer):
    """Sum of the columns; unknown where one is."""

    trainable = False
    multivariate = True

    def __init__(self) -> None:
        pass

    def _compute(self, series: Series) -> Series:
        return series.with_values({"sum": reduce(lambda a, b: a + b, [F.col(c) for c in series.values])})


def moving_average(c: str, series: Series, period: int) -> Column:
    """Centred moving average over one period; ends count half where the period is even; null where a value misses."""
    half = period // 2
    w = series.ordered.rowsBetween(-half, half)
    total = F.sum(c).over(w)
    if period % 2 == 0:
        total = total - (F.lag(c, half).over(series.ordered) + F.lead(c, half).over(series.ordered)) / 2
    return F.when(F.count(c).over(w) == 2 * half + 1, total / period)


class SeasonalDecomposition(BaseTransformer):
    """Residual, seasonal part or trend around a profile of means per phase, learned from the training series.

    The period may be detected.  Later series must keep the step, and stand on the grid that training began.
    """

    def __init__(self, period: int | None = None, trend: bool = False, component: str = "residual"):
        self.period, self.trend, self.component = period, trend, component
        if component not in ("residual", "seasonal", "trend"):
            raise ValueError("component is residual, seasonal or trend")

    def _learn(self, series: Series) -> None:
        self.step_ = series.required_freq("SeasonalDecomposition")
        if self.period is not None and self.period < 2:
            raise ValueError("a period has two steps at least")
        if self.period is None:
            if series.keys:
                raise ValueError("give the period for series with keys")
            self.period_ = {c: detect_period(series.column_values(c)) for c in series.values}
        else:
            self.period_ = {c: int(self.period) for c in series.values}
        n = series.df.groupBy(*series.keys).count().agg(F.min("count")).first()[0] or 0
        if n < 2 * max(self.period_.values()):
            raise ValueError(f"{n} rows are less than two periods")
        start = series.df.groupBy(*series.keys).agg(F.min(TIME).alias("x__start"))
        self.start_ = start.persist() if series.keys else {"x": {"start": start.first()[0]}}
        profiles = {}
        for c in series.values:
            p = self.period_[c]
            detrended = series.with_values({c: F.col(c) - moving_average(c, series, p)}) if self.trend else series
            at = Attached(detrended, self.start_)
            phase = F.pmod(F.floor((F.col(TIME) - at("x", "start")) / self.step_), F.lit(p)).cast("int")
            means = at.df.select(*series.keys, phase.alias("phase"), c).groupBy(*series.keys, "phase").agg(F.avg(c).alias("m")).where("m IS NOT NULL")
            held = means.groupBy(*series.keys).agg(F.map_from_entries(F.collect_list(F.struct("phase", "m"))).alias(f"{c}__profile"))
            if self.trend:  # the profile of a detrended series is centred
                mean = F.aggregate(F.map_values(f"{c}__profile"), F.lit(0.0), lambda s, x: s + x) / F.size(f"{c}__profile")
                held = held.withColumn(f"{c}__profile", F.transform_values(f"{c}__profile", lambda k, v: v - mean))
            if series.keys:
                profiles[c] = held.persist()
            else:
                row = held.first()
                found = dict(row[0]) if row else {}
                if len(found) < p:
                    raise ValueError(f"{c}: {p - len(found)} of {p} phases have no value")
                profiles[c] = {c: {"profile": [found[i] for i in range(p)]}}
        self.profile_ = profiles

    @property
    def seasonal_(self) -> dict[str, Any]:
        return {c: m[c]["profile"] if isinstance(m, dict) else m for c, m in self.profile_.items()}

    def _compute(self, series: Series) -> Series:
        if series.freq != self.step_:
            raise ValueError("the series' step is not that of training")
        at = Attached(series, self.start_)
        off = F.col(TIME) - at("x", "start")
        steps = F.when(off % self.step_ != 0, F.raise_error(F.lit("a time is off the grid of training")).cast("long")).otherwise(F.floor(off / self.step_))
        df, out = at.df.withColumn("__n", steps), {}
        for c in series.values:
            model = Attached(series, self.profile_[c], df)
            df = model.df
            phase = F.pmod(F.col("__n"), F.lit(self.period_[c])).cast("int")
            seasonal = F.element_at(model(c, "profile"), phase + 1) if model.local is not None else F.try_element_at(model(c, "profile"), phase)
            trend = moving_average(c, series, self.period_[c]) if self.trend else F.lit(0.0)
            out[c] = {"seasonal": F.when(F.col(c).isNotNull(), seasonal) if False else seasonal, "trend": trend, "residual": F.col(c) - trend - seasonal}[self.component]
        return series.with_values(out, df)


class Regressor(Protocol):
    """What a regression needs: ``fit(X, y)`` and ``predict(X)`` on arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Any: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class OrdinaryLeastSquares:
    """Least squares with an intercept; of several solutions the shortest."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> OrdinaryLeastSquares:
        x, y = np.asarray(x, float), np.asarray(y, float)
        mean, level = x.mean(axis=0), y.mean()
        self.coefficients_ = np.linalg.lstsq(x - mean, y - level, rcond=None)[0]
        self.intercept_ = float(level - mean @ self.coefficients_)
        return self

    @classmethod
    def of_moments(cls, mean: np.ndarray, level: float, gram: np.ndarray, cross: np.ndarray) -> OrdinaryLeastSquares:
        """From means and centred second moments, which one aggregate job gives."""
        out = cls()
        out.coefficients_ = np.linalg.lstsq(gram, cross, rcond=None)[0]
        out.intercept_ = float(level - mean @ out.coefficients_)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, float) @ self.coefficients_ + self.intercept_


def moments(series: Series, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, centred cross products per row and the number of the complete rows; one job, any number of rows."""
    whole = series.select(*names).complete_rows().df
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = whole.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.covar_pop(a, b) for a, b in pairs]).first()
    n, k = row[0], len(names)
    mean = np.array([x if x is not None else np.nan for x in row[1 : 1 + k]], float)
    gram = np.zeros((k, k))
    for (a, b), v in zip(pairs, row[1 + k :], strict=True):
        i, j = names.index(a), names.index(b)
        gram[i, j] = gram[j, i] = v if v is not None else np.nan
    return mean, gram, n


def linear(weights: Sequence[float], offset: float, names: Sequence[str]) -> Column:
    return reduce(lambda s, x: s + x, [F.lit(float(w)) * F.col(c) for w, c in zip(weights, names, strict=True)], F.lit(float(offset)))


class RegressionResidual(BaseTransformer):
    """What a regression of ``target`` on the other columns leaves."""

    multivariate = True

    def __init__(self, target: str, regressor: Any = None):
        self.target, self.regressor = target, regressor

    def _learn(self, series: Series) -> None:
        if series.keys:
            raise ValueError("regressions are fitted on one series")
        if self.target not in series.values or len(series.values) < 2:
            raise ValueError("a regression needs its target and another column")
        names = [c for c in series.values if c != self.target]
        if self.regressor is None:
            mean, gram, n = moments(series, [*names, self.target])
            if not n:
                raise ValueError("no complete row")
            self.regressor_ = OrdinaryLeastSquares.of_moments(mean[:-1], mean[-1], gram[:-1, :-1], gram[:-1, -1])
        else:
            rows = series.complete_rows().df.select(*names, self.target).toPandas()  # a regressor of the user's fits in memory
            if rows.empty:
                raise ValueError("no complete row")
            self.regressor_ = copy.deepcopy(self.regressor)
            self.regressor_.fit(rows[names].to_numpy(), rows[self.target].to_numpy())

    def _compute(self, series: Series) -> Series:
        names = [c for c in series.values if c != self.target]
        if isinstance(self.regressor_, OrdinaryLeastSquares):
            return series.with_values({"residual": F.col(self.target) - linear(self.regressor_.coefficients_, self.regressor_.intercept_, names)})
        model = self.regressor_

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            ok, out = ~np.isnan(x).any(axis=1), np.full(len(x), np.nan)
            if ok.any():
                out[ok] = model.predict(x[ok])
            return pd.Series(out)

        fitted = predicted(*[F.col(c) for c in names])
        return series.with_values({"residual": F.col(self.target) - F.when(~F.isnan(fitted), fitted)})


class PcaBase(BaseTransformer):
    """Leading components of the complete rows' covariance; each vector's largest entry is positive."""

    multivariate = True

    def __init__(self, k: int = 1):
        self.k = k

    def _learn(self, series: Series) -> None:
        if series.keys:
            raise ValueError("components are fitted on one series")
        if not 1 <= self.k <= len(series.values):
            raise ValueError(f"k is between 1 and {len(series.values)}")
        mean, gram, n = moments(series, series.values)
        if n < self.k:
            raise ValueError(f"{n} complete rows are too few for {self.k} components")
        values, vectors = np.linalg.eigh(gram)
        top = vectors[:, np.argsort(-values, kind="stable")[: self.k]].T
        sign = np.sign(top[np.arange(self.k), np.abs(top).argmax(axis=1)])
        self.mean_, self.components_ = mean, top * np.where(sign == 0, 1, sign)[:, None]

    def _scores(self, names: Sequence[str]) -> list[Column]:
        return [linear(v, -float(v @ self.mean_), names) for v in self.components_]

    def _rebuilt(self, names: Sequence[str]) -> list[Column]:
        """The rows' projections onto the components' plane: linear in the columns."""
        plane = self.components_.T @ self.components_
        return [linear(plane[i], float(self.mean_[i] - plane[i] @ self.mean_), names) for i in range(len(names))]


class PcaProjection(PcaBase):
    def _compute(self, series: Series) -> Series:
        return series.with_values({f"pc{i}": s for i, s in enumerate(self._scores(self.columns_))})


class PcaReconstruction(PcaBase):
    def _compute(self, series: Series) -> Series:
        return series.with_values(dict(zip(self.columns_, self._rebuilt(self.columns_), strict=True)))


class PcaColumnError(PcaBase):
    """Squared residual of each column."""

    def _compute(self, series: Series) -> Series:
        rebuilt = self._rebuilt(self.columns_)
        return series.with_values({c: (F.col(c) - r) * (F.col(c) - r) for c, r in zip(self.columns_, rebuilt, strict=True)})


class PcaReconstructionError(PcaBase):
    """Sum of the columns' squared residuals."""

    def _compute(self, series: Series) -> Series:
        rebuilt = self._rebuilt(self.columns_)
        return series.with_values({"error": reduce(lambda a, b: a + b, [(F.col(c) - r) * (F.col(c) - r) for c, r in zip(self.columns_, rebuilt, strict=True)])})


class CustomizedTransformer(BaseTransformer):
    """A function of the user's.

    ``transform_func(series, **params)`` gets a :class:`Series` and returns one, lazily, or with ``matrix=True`` the array
    of a whole series' values (rows by columns) and returns as many rows.  ``fit_func(series, **params)`` returns more
    keyword arguments; those given outright win.
    """

    multivariate = True

    def __init__(self, transform_func: Callable, transform_func_params: dict | None = None, fit_func: Callable | None = None, fit_func_params: dict | None = None, matrix: bool = False):
        self.transform_func, self.transform_func_params, self.fit_func, self.fit_func_params, self.matrix = transform_func, transform_func_params, fit_func, fit_func_params, matrix

    @property
    def fitted(self) -> bool:
        return self.fit_func is None or getattr(self, "columns_", None) is not None

    def _learn(self, series: Series) -> None:
        self.learned_ = dict(self.fit_func(series, **(self.fit_func_params or {}))) if self.fit_func else {}

    def _compute(self, series: Series) -> Series:
        params = {**getattr(self, "learned_", {}), **(self.transform_func_params or {})}
        if not self.matrix:
            return self.transform_func(series, **params)
        function, names = self.transform_func, series.values

        def run(_: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            x = np.column_stack([columns[c] for c in names])
            out = np.asarray(function(x, **params), float).reshape(len(x), -1)
            if out.shape[1] != len(names):
                raise ValueError("a matrix function keeps the number of columns")
            return {c: out[:, i] for i, c in enumerate(names)}

        return series.per_series(run, names)


__all__ = [
    "CustomizedTransformer", "DoubleRollingAggregate", "OrdinaryLeastSquares", "PcaColumnError", "PcaProjection", "PcaReconstruction", "PcaReconstructionError",
    "RegressionResidual", "Regressor", "Retrospect", "RollingAggregate", "SeasonalDecomposition", "StandardScale", "SumAll", "aggregate", "learn", "parse_duration", "T",
]
