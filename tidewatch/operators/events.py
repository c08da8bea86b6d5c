"""Events: sorted disjoint closed intervals of nanoseconds, per series and optionally per name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.durations import parse_duration
from tidewatch.sources.series import TIME, Series, nanoseconds

START, END = "start_ns", "end_ns"


def merged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Islands: intervals that overlap or touch (gaps under a nanosecond) become one."""
    w = Window.partitionBy(*by).orderBy(START, END)
    before = F.max(END).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    new = F.when(before.isNull() | (F.col(START) > before + 1), 1).otherwise(0)
    df = df.select(*by, START, END).withColumn("__new", new).withColumn("__island", island)
    return df.groupBy(*by, "__island").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("__island")


@dataclass(frozen=True)
class Events:
    """``df`` has the columns ``by``, ``start_ns`` and ``end_ns``; intervals of one series are disjoint."""

    df: DataFrame
    by: tuple[str, ...] = ()

    @classmethod
    def of(cls, data: Any, by: Sequence[str] = (), start: str = "start", end: str = "end") -> Events:
        """Events of a DataFrame with two columns of times, or of bounds held on the driver (a list, tuple or array as
        :meth:`from_bounds` takes, or a pandas frame); intervals that end before they start raise."""
        if isinstance(data, Events):
            return data
        if isinstance(data, pd.DataFrame):
            a, b = (START, END) if START in data else (start, end)
            data = data[[a, b]].to_numpy()
        if isinstance(data, list | tuple | np.ndarray):
            return cls.from_bounds(SparkSession.getActiveSession(), data)
        if START in data.columns:
            start, end = START, END
        a, b = nanoseconds(data, start), nanoseconds(data, end)
        b = F.when(b < a, F.raise_error(F.lit("an event ends before it starts")).cast("long")).otherwise(b)
        return cls(merged(data.select(*by, a.alias(START), b.alias(END)), by), tuple(by))

    @classmethod
    def from_bounds(cls, spark: SparkSession, bounds: Any) -> Events:
        """Events of n x 2 nanoseconds or datetimes; single times are instants."""
        rows = []
        for x in bounds:
            a, b = x if isinstance(x, list | tuple | np.ndarray) else (x, x)
            a, b = (int(v) if isinstance(v, int | np.integer) else int(pd.Timestamp(v).value) for v in (a, b))
            if b < a:
                raise ValueError("an event ends before it starts")
            rows.append((a, b))
        return cls(merged(spark.createDataFrame(rows, f"{START} long, {END} long"), ()))

    from_any = of

    @classmethod
    def empty(cls, spark: SparkSession) -> Events:
        return cls(spark.createDataFrame([], f"{START} long, {END} long"))

    @property
    def n_events(self) -> int:
        return self.df.count()

    def durations(self) -> DataFrame:
        return self.df.select(*self.by, START, (F.col(END) - F.col(START) + 1).alias("duration"))

    @property
    def total_duration(self) -> int:
        return self.durations().agg(F.sum("duration")).first()[0] or 0

    def _covered(self, other: Events, least: int) -> Events:
        """Where at least ``least`` of the two are: a sweep over the boundaries, no interval join."""
        if self.by != other.by:
            raise ValueError("events need equal keys")
        ends = [e.df.select(*self.by, F.col(c).alias("p"), F.lit(d).alias("d")) for e in (self, other) for c, d in ((START, 1), (END, -1))]
        points = ends[0]
        for e in ends[1:]:
            points = points.unionAll(e)
        points = points.select(*self.by, F.when(F.col("d") < 0, F.col("p") + 1).otherwise(F.col("p")).alias("p"), "d")
        steps = points.groupBy(*self.by, "p").agg(F.sum("d").alias("d"))
        w = Window.partitionBy(*self.by).orderBy("p")
        held = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("p").over(w))
        held = held.where(F.col("n") >= least).select(*self.by, F.col("p").alias(START), (F.col("next") - 1).alias(END))
        return Events(merged(held, self.by), self.by)

    def intersect(self, other: Events) -> Events:
        return self._covered(other, 2)

    def union(self, other: Events) -> Events:
        return self._covered(other, 1)

    def expand(self, before: Any = 0, after: Any = 0) -> Events:
        a, b = widened(before), widened(after)
        return Events(merged(self.df.select(*self.by, (F.col(START) - a).alias(START), (F.col(END) + b).alias(END)), self.by), self.by)

    def to_frame(self, timestamps: bool = False) -> DataFrame:
        if not timestamps:
            return self.df
        stamp = lambda c: F.timestamp_micros(F.floor(F.col(c) / 1000))
        return self.df.select(*self.by, stamp(START).alias("start"), stamp(END).alias("end"))

    def to_list(self) -> list:
        """Pairs of nanoseconds in order; instants as single numbers."""
        rows = self.df.select(START, END).orderBy(START).collect()
        return [r[0] if r[0] == r[1] else (r[0], r[1]) for r in rows]


def widened(x: Any) -> int:
    if isinstance(x, bool | float):
        raise TypeError("a margin is a duration or a number of nanoseconds")
    n = x if isinstance(x, int) else parse_duration(x)
    if n < 0:
        raise ValueError("a margin is not negative")
    return n


def expand_events(events: Events, *, before: str | int | timedelta = 0, after: str | int | timedelta = 0) -> Events:
    return events.expand(before, after)


def to_events(labels: Any, *, as_periods: bool | None = None) -> Events:
    """Runs of labels of one or more.  On an even axis a label stands for its whole step, else for its instant.

    Of several columns each gives events under its name."""
    series = Series.of(labels)
    wide = len(series.values) > 1
    df = series.with_step()
    flagged = [df.where(F.col(c) >= 1).select(*series.keys, *([F.lit(c).alias("name")] if wide else []), TIME, "__step") for c in series.values]
    rows = flagged[0]
    for f in flagged[1:]:
        rows = rows.unionAll(f)
    step = F.lit(1).cast("long") if as_periods is False else F.coalesce("__step", F.lit(1).cast("long"))
    if as_periods:
        step = F.when(F.col("__step").isNull(), F.raise_error(F.lit("an uneven axis has no periods")).cast("long")).otherwise(F.col("__step"))
    by = (*series.keys, *(["name"] if wide else []))
    rows = rows.select(*by, F.col(TIME).alias(START), (F.col(TIME) + step - 1).alias(END))
    return Events(merged(rows, by), by)


def to_labels(events: Events, axis: Any, *, as_periods: bool | None = None, name: str = "label") -> Series:
    """1 for the samples whose period (or instant) meets an event, 0 for the others, on the axis of ``axis``.

    A sweep: events start and end as +1 and -1 on the same line as the samples, so no interval join is needed."""
    series = Series.of(axis)
    if events.by != series.keys:
        raise ValueError("events need the series' keys")
    df = series.with_step().select(*series.axis, "__step")
    step = F.lit(1).cast("long") if as_periods is False else F.coalesce("__step", F.lit(1).cast("long"))
    if as_periods:
        step = F.when(F.col("__step").isNull(), F.raise_error(F.lit("an uneven axis has no periods")).cast("long")).otherwise(F.col("__step"))
    # a sample meets an event if the last event that starts by its period's end has not ended before it
    samples = df.select(*series.keys, (F.col(TIME) + step - 1).alias("p"), F.lit(1).alias("k"), F.col(TIME).alias("t"), F.lit(None).cast("long").alias("e"))
    starts = events.df.select(*series.keys, F.col(START).alias("p"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("t"), F.col(END).alias("e"))
    w = Window.partitionBy(*series.keys).orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)
    marked = samples.unionAll(starts).withColumn("last", F.max("e").over(w)).where("k = 1")
    label = F.when(F.col("last") >= F.col("t"), 1.0).otherwise(0.0)
    return Series(marked.select(*series.keys, F.col("t").alias(TIME), label.alias(name)), (name,), series.keys)


SCHEMA = T.StructType([T.StructField(START, T.LongType()), T.StructField(END, T.LongType())])
