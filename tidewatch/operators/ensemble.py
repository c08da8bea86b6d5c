"""Aggregators: several label (or score) columns to one.  A label is anomalous when it is known and not zero."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewatch.functions.kernels import MAD_SCALE
from tidewatch.operators.component import Attached, BaseAggregator, learn
from tidewatch.sources.series import Series


def every(columns: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    return reduce(join, columns)


class OrAggregator(BaseAggregator):
    """1 if any is; else unknown if any is; else 0."""

    def __init__(self) -> None:
        pass

    def _combine(self, labels: list[Column], series: Series) -> Column:
        return every([x != 0 for x in labels], lambda a, b: a | b).cast("double")  # SQL's own three values


class AndAggregator(BaseAggregator):
    """0 if any is; else unknown if any is; else 1."""

    def __init__(self) -> None:
        pass

    def _combine(self, labels: list[Column], series: Series) -> Column:
        return every([x != 0 for x in labels], lambda a, b: a & b).cast("double")


class VoteAggregator(BaseAggregator):
    """1 if the share of anomalous ones among the known reaches the threshold."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold
        if not 0 <= threshold <= 1:
            raise ValueError("threshold is between 0 and 1")

    def _combine(self, labels: list[Column], series: Series) -> Column:
        plus = lambda a, b: a + b
        known = every([x.isNotNull().cast("int") for x in labels], plus)
        votes = every([F.coalesce((x != 0).cast("int"), F.lit(0)) for x in labels], plus)
        return F.when(known > 0, (votes >= F.lit(float(self.threshold)) * known).cast("double"))


class ScoreAggregator(BaseAggregator):
    """Scores made comparable column by column, then reduced row by row over those that are known."""

    def __init__(self, how: str = "mean", normalize: str = "rank"):
        self.how, self.normalize = how, normalize
        if how not in ("mean", "max", "median") or normalize not in ("rank", "robust", "none"):
            raise ValueError("how is mean, max or median; normalize is rank, robust or none")

    def _normalised(self, series: Series) -> Series:
        if self.normalize == "none":
            return series
        if self.normalize == "rank":

            def midrank(c: str) -> Column:
                known = F.col(c).isNotNull()
                per = Window.partitionBy(*series.keys, known)
                ties = F.count(c).over(Window.partitionBy(*series.keys, c))
                rank = F.rank().over(per.orderBy(c)) + (ties - 1) / 2.0
                n = F.count(c).over(per)
                return F.when(known, F.when(n > 1, (rank - 1) / F.when(n > 1, n - 1.0)).otherwise(0.5))

            return series.with_values({c: midrank(c) for c in series.values})
        medians = learn(series, {c: {"median": F.percentile(c, F.lit(0.5))} for c in series.values})
        at = Attached(series, medians)
        away = series.with_values({c: F.col(c) - at(c, "median") for c in series.values}, at.df)
        spreads = learn(away, {c: {"mad": F.percentile(F.abs(c), F.lit(0.5)) * MAD_SCALE} for c in away.values})
        at = Attached(away, spreads)
        return away.with_values({c: F.col(c) / F.when(at(c, "mad") > 0, at(c, "mad")).otherwise(1.0) for c in away.values}, at.df)

    def _compute(self, series: Series) -> Series:
        scores = self._normalised(series)
        known = F.sort_array(F.array_compact(F.array(*[F.col(c) for c in scores.values])))
        n = F.size(known)
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
        middle = (F.element_at(known, F.floor((n + 1) / 2).cast("int")) + F.element_at(known, F.floor((n + 2) / 2).cast("int"))) / 2
        out = {"mean": total / F.when(n > 0, n), "max": F.array_max(known), "median": F.when(n > 0, middle)}[self.how]
        return scores.with_values({"anomaly": F.when(n > 0, out)})


class CustomizedAggregator(BaseAggregator):
    """A function of the user's: label columns in, one Column out."""

    def __init__(self, aggregate_func: Callable, aggregate_func_params: dict | None = None):
        self.aggregate_func, self.aggregate_func_params = aggregate_func, aggregate_func_params

    def _combine(self, labels: list[Column], series: Series) -> Any:
        return self.aggregate_func(labels, **(self.aggregate_func_params or {}))
