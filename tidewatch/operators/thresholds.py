"""Thresholds: scores to labels.

A score is anomalous strictly outside its fence; an unknown score or an unlearned fence gives an unknown label.  An
open side is infinite.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.kernels import LEAST_PEAKS, MAD_SCALE, esd_critical, esd_survivors, gpd_fit, pot_fence
from tidewatch.operators.component import Attached, BaseThreshold, learn, quantiles
from tidewatch.sources.series import Series

INFINITY = float("inf")


def outside(score: Column, low: Column, high: Column) -> Column:
    """1 outside [low, high], 0 inside, null where anything is unknown."""
    known = score.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.when((score > high) | (score < low), 1.0).otherwise(0.0))


def sides(factor: Any) -> tuple[float | None, float | None]:
    low, high = factor if isinstance(factor, tuple) else (factor, factor)
    for f in (low, high):
        if f is not None and f < 0:
            raise ValueError("a factor is not negative")
    return low, high


class Numbers:
    """A learned model of one series, read as plain numbers."""

    def __init__(self, model: dict):
        self.model = model

    def __call__(self, column: str, name: str) -> float | None:
        return self.model[column][name]


def both(series: Series, first: Any, second: Any) -> Any:
    """Two learned models as one."""
    if isinstance(first, dict):
        return {c: {**first[c], **second[c]} for c in first}
    return first.join(second, list(series.keys), "left")


def fenced(series: Series, found: Any, edges: Any, known: str) -> Any:
    """Fences ``edges(at, column)`` of learned numbers; None is an open side, open only where something is known."""
    if isinstance(found, dict):
        at, out = Numbers(found), {}
        for c in series.values:
            some = found[c][known] is not None
            low, high = edges(at, c) if some else (None, None)
            out[c] = {"low": (-INFINITY if low is None else low) if some else None, "high": (INFINITY if high is None else high) if some else None}
        return out
    at = lambda c, n: F.col(f"{c}__{n}")
    columns = []
    for c in series.values:
        low, high = edges(at, c)
        some = at(c, known).isNotNull()
        columns += [F.when(some, F.lit(-INFINITY) if low is None else low).alias(f"{c}__low"), F.when(some, F.lit(INFINITY) if high is None else high).alias(f"{c}__high")]
    return found.select(*series.keys, *columns).persist()


class FencedThreshold(BaseThreshold):
    """Learns ``low`` and ``high`` per column; applying is one expression per column."""

    def _fences(self) -> dict[str, dict[str, float | None]] | Any:
        return self.fences_

    @property
    def low_(self) -> Any:
        return {c: f["low"] for c, f in self.fences_.items()} if isinstance(self.fences_, dict) else self.fences_

    @property
    def high_(self) -> Any:
        return {c: f["high"] for c, f in self.fences_.items()} if isinstance(self.fences_, dict) else self.fences_

    def _compute(self, series: Series) -> Series:
        at = Attached(series, self._fences())
        return series.with_values({c: outside(F.col(c), at(c, "low"), at(c, "high")) for c in series.values}, at.df)


class FixedThreshold(BaseThreshold):
    """Given bounds, one at least.  A bound that is NaN is unknown, and so is every label."""

    trainable = False

    def __init__(self, low: float | None = None, high: float | None = None):
        self.low, self.high = low, high
        if low is None and high is None:
            raise ValueError("a fixed threshold needs a bound")

    def _compute(self, series: Series) -> Series:
        low, high = (F.lit(open_ if x is None else None if math.isnan(x) else float(x)).cast("double") for x, open_ in ((self.low, -INFINITY), (self.high, INFINITY)))
        return series.with_values({c: outside(F.col(c), low, high) for c in series.values})


class QuantileThreshold(FencedThreshold):
    """Exact quantiles with linear interpolation."""

    def __init__(self, low: float | None = None, high: float | None = None):
        self.low, self.high = low, high
        for q in (low, high):
            if q is not None and not 0 <= q <= 1:
                raise ValueError("quantiles are between 0 and 1")
        if low is None and high is None:
            raise ValueError("a quantile threshold needs a bound")

    def _learn(self, series: Series) -> None:
        wanted = {n: q for n, q in (("low", self.low), ("high", self.high)) if q is not None}
        found = quantiles(series, {c: wanted for c in series.values})
        self.fences_ = fenced(series, found, lambda at, c: (None if self.low is None else at(c, "low"), None if self.high is None else at(c, "high")), next(iter(wanted)))


class IqrThreshold(FencedThreshold):
    """Quartiles widened by a factor of their distance."""

    def __init__(self, factor: Any = 3.0):
        self.factor = factor
        sides(factor)

    def _learn(self, series: Series) -> None:
        low, high = sides(self.factor)
        found = quantiles(series, {c: {"a": 0.25, "b": 0.75} for c in series.values})

        def edges(at: Any, c: str) -> tuple:
            a, b = at(c, "a"), at(c, "b")
            return None if low is None else a - low * (b - a), None if high is None else b + high * (b - a)

        self.fences_ = fenced(series, found, edges, "a")


class MadThreshold(FencedThreshold):
    """Median widened by a factor of the scaled median absolute deviation; two passes."""

    def __init__(self, factor: Any = 3.0):
        self.factor = factor
        sides(factor)

    def _learn(self, series: Series) -> None:
        low, high = sides(self.factor)
        medians = quantiles(series, {c: {"m": 0.5} for c in series.values})
        at = Attached(series, medians)
        away = series.with_values({c: F.abs(F.col(c) - at(c, "m")) for c in series.values}, at.df)
        found = both(series, medians, quantiles(away, {c: {"d": 0.5} for c in series.values}))

        def edges(at: Any, c: str) -> tuple:
            m, d = at(c, "m"), at(c, "d") * MAD_SCALE
            return None if low is None else m - low * d, None if high is None else m + high * d

        self.fences_ = fenced(series, found, edges, "m")


class EsdThreshold(BaseThreshold):
    """Generalised extreme studentized deviate: the test's survivors are kept as count, sum and sum of squares, and a
    score is anomalous when adding it to them would make it an outlier."""

    def __init__(self, alpha: float = 0.05):
        self.alpha = alpha
        if not 0 < alpha < 1:
            raise ValueError("alpha is between 0 and 1")

    def _learn(self, series: Series) -> None:
        alpha, names, by = self.alpha, list(series.values), series.keys

        def kept(pdf: pd.DataFrame) -> pd.DataFrame:
            out: dict[str, Any] = {k: [pdf[k].iloc[0]] for k in by}
            for c in names:
                n, total, squares = esd_survivors(pdf[c].to_numpy(float, na_value=np.nan), alpha)
                out |= {f"{c}__n": [float(n)], f"{c}__total": [total], f"{c}__squares": [squares], f"{c}__critical": [esd_critical(n + 1, alpha)]}
            return pd.DataFrame(out)

        fields = ", ".join(f"`{c}__{s}` double" for c in names for s in ("n", "total", "squares", "critical"))
        keys = "".join(f"`{k}` {series.df.schema[k].dataType.simpleString()}, " for k in series.keys)
        grouped = series.df.groupBy(*series.keys) if series.keys else series.df.groupBy(F.lit(0).alias("__all"))
        out = grouped.applyInPandas(kept, keys + fields)
        if series.keys:
            self.model_ = out.persist()
        else:
            row = out.first()
            self.model_ = {c: {s: row[f"{c}__{s}"] for s in ("n", "total", "squares", "critical")} for c in names} if row else {}

    def _compute(self, series: Series) -> Series:
        at, out = Attached(series, self.model_), {}
        for c in series.values:
            x, n = F.col(c), at(c, "n") + 1
            total = at(c, "total") + x
            mean = total / n
            var = F.greatest((at(c, "squares") + x * x - total * total / n) / F.when(n > 1, n - 1), F.lit(0.0))
            stat = F.when(var > 0, F.abs(x - mean) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
            out[c] = F.when(x.isNotNull() & (at(c, "n") > 0), F.when(stat > at(c, "critical"), 1.0).otherwise(0.0))
        return series.with_values(out, at.df)


class PotThreshold(FencedThreshold):
    """Peaks over threshold: the fence is the level that a generalised Pareto tail, fitted to the excesses over a high
    quantile, passes with the target probability.  Only the tail comes to the driver.  ``update`` goes on from there."""

    def __init__(self, low: float | None = None, high: float | None = 1e-4, level: float = 0.98):
        self.low, self.high, self.level = low, high, level
        if low is None and high is None:
            raise ValueError("a side needs a target probability")
        if not 0.5 <= level < 1:
            raise ValueError("level is a quantile from 0.5 up")
        for p in (low, high):
            if p is not None and not 0 < p < 1:
                raise ValueError("targets are probabilities")

    def _learn(self, series: Series) -> None:
        starts = quantiles(series, {c: {"low": 1 - self.level, "high": self.level} for c in series.values})
        counts = learn(series, {c: {"n": F.count(c)} for c in series.values})
        if series.keys:
            self.fences_ = self._fences_of_keys(series, both(series, starts, counts))
            return
        self.fences_, self.tails_ = {}, {}
        for c in series.values:
            fence = {}
            for side, sign, target in (("low", -1, self.low), ("high", 1, self.high)):
                if target is None:
                    fence[side] = sign * INFINITY
                    continue
                start = starts[c][side]
                tail = {"start": None if start is None else sign * start, "count": counts[c]["n"], "peaks": [], "target": target}
                if start is not None:
                    over = series.df.select((F.col(c) * sign - tail["start"]).alias("y")).where("y > 0")
                    tail["peaks"] = [r.y for r in over.collect()]  # a share of 1 - level of the rows
                self.tails_[f"{c}:{side}"] = tail
                edge = self._fit(tail)
                fence[side] = None if edge is None else sign * edge
            self.fences_[c] = fence

    def _fences_of_keys(self, series: Series, starts: DataFrame) -> DataFrame:
        """Fences per key: only the rows beyond a key's starts are gathered, each key's in a task."""
        keys, fit, out = list(series.keys), self._fit, starts

        def edge_of(sign: int, target: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
            def edge(pdf: pd.DataFrame) -> pd.DataFrame:
                found = fit({"start": float(pdf["start"].iloc[0]), "count": int(pdf["n"].iloc[0]), "peaks": pdf["y"].tolist(), "target": target})
                return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "edge": [None if found is None else sign * found]})

            return edge

        for c in series.values:
            for side, sign, target in (("low", -1, self.low), ("high", 1, self.high)):
                if target is None:
                    out = out.withColumn(f"{c}__{side}_fence", F.lit(sign * INFINITY))
                    continue
                over = series.df.select(*keys, F.col(c).alias("x")).join(starts.select(*keys, F.col(f"{c}__{side}").alias("start"), F.col(f"{c}__n").alias("n")), keys)
                over = over.select(*keys, (sign * F.col("x") - sign * F.col("start")).alias("y"), (sign * F.col("start")).alias("start"), "n").where("y > 0")

                kinds = "".join(f"`{k}` {series.df.schema[k].dataType.simpleString()}, " for k in keys)
                edges = over.groupBy(*keys).applyInPandas(edge_of(sign, target), kinds + "edge double").withColumnRenamed("edge", f"{c}__{side}_fence")
                out = out.join(edges, keys, "left")
        fences = [F.col(f"{c}__{side}_fence").alias(f"{c}__{side}") for c in series.values for side in ("low", "high")]
        return out.select(*keys, *fences).persist()

    @staticmethod
    def _fit(tail: dict) -> float | None:
        n = len(tail["peaks"])
        if n < LEAST_PEAKS:
            return None
        conditional = tail["target"] * tail["count"] / n
        if conditional >= 1:
            raise ValueError("the target is met before the tail begins; raise the level or lower the target")
        tail["shape"], tail["scale"] = (float(v) for v in gpd_fit(np.array(tail["peaks"])))
        return float(pot_fence(tail["start"], tail["shape"], tail["scale"], conditional))

    def update(self, value: float) -> float:
        """Label of a new value; a normal one is absorbed, and moves the fence."""
        if len(self.fences_) != 1:
            raise ValueError("only a threshold of one column goes on value by value")
        (column, fence) = next(iter(self.fences_.items()))
        if value is None or math.isnan(value):
            return math.nan
        if fence["low"] is None or fence["high"] is None:
            return math.nan
        if value > fence["high"] or value < fence["low"]:
            return 1.0
        for side, sign in (("low", -1), ("high", 1)):
            tail = self.tails_.get(f"{column}:{side}")
            if tail is None:
                continue
            tail["count"] += 1
            y = sign * value - tail["start"]
            if y > 0:
                tail["peaks"].append(y)
            n = len(tail["peaks"])
            if (conditional := tail["target"] * tail["count"] / n) < 1:
                if y > 0:
                    tail["shape"], tail["scale"] = (float(v) for v in gpd_fit(np.array(tail["peaks"])))
                fence[side] = sign * float(pot_fence(tail["start"], tail["shape"], tail["scale"], conditional))
        return 0.0

    def update_many(self, values: Any) -> np.ndarray:
        return np.array([self.update(float(v)) for v in values])
