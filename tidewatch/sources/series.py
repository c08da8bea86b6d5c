"""Time series as DataFrames: keys, a BIGINT time in nanoseconds, and DOUBLE values.

One table may hold many series, told apart by key columns; without keys it is one series.  Missing values are null:
NaN becomes null on the way in, so that no comparison or aggregate ever meets one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.durations import parse_duration

TIME = "t_ns"
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def nanoseconds(df: DataFrame, name: str) -> Column:
    """The column ``name`` as nanoseconds since 1970 (UTC); a number is taken as such."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400 * 10**9)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)") * F.lit(1000)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) * F.lit(1000)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"{name} is no time column: {kind.simpleString()}")


def present(c: Column) -> Column:
    """``c`` as a double, with NaN as null."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


@dataclass(frozen=True)
class Series:
    """``df`` has the columns ``keys``, ``t_ns``, ``values`` and those that are carried along; times are unique within a
    series, unless it was made with ``repeats``: then windows of durations and statistics of whole series take every row,
    and what counts rows in order or joins by time is not for it."""

    df: DataFrame
    values: tuple[str, ...]
    keys: tuple[str, ...] = ()
    carry: tuple[str, ...] = ()

    @classmethod
    def of(cls, data: Any, time: str | None = None, keys: Sequence[str] = (), values: Sequence[str] | None = None, order: Sequence[str] = (), unique: bool = False, repeats: bool = False) -> Series:
        """A series of a DataFrame.

        ``time`` defaults to ``t_ns`` or the only temporal column.  ``values`` default to all other columns but keys and
        ``order``.  Of rows with equal times the first by ``order`` stays (by the values, where that is empty: rows of a
        DataFrame have no order of their own); ``unique`` says that there are none, and saves the shuffle; with ``repeats``
        all of them stay.
        """
        if isinstance(data, Series):
            return data
        df: DataFrame = data
        if time is None:
            found = [TIME] if TIME in df.columns else [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL) and f.name not in keys]
            if len(found) != 1:
                raise ValueError(f"name the time column: there are {found or 'none'}")
            time = found[0]
        names = [c for c in df.columns if c not in (time, *keys, *order)] if values is None else list(values)
        if not names:
            raise ValueError("a series has one value column at least")
        for c in names:
            if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
                raise TypeError(f"{c} is no number: {df.schema[c].dataType.simpleString()}")
        at = nanoseconds(df, time)
        checked = F.when(at.isNull(), F.raise_error(F.lit(f"{time} has a missing time")).cast("long")).otherwise(at)
        out = df.select(*keys, checked.alias(TIME), *[present(F.col(c)).alias(c) for c in names], *[F.col(c).alias(f"__{c}") for c in order])
        if not (unique or repeats):
            first = [f"__{c}" for c in order] or [F.col(c).asc_nulls_last() for c in names]
            turn = F.row_number().over(Window.partitionBy(*keys, TIME).orderBy(*first))
            out = out.withColumn("__turn", turn).where("__turn = 1")
        return cls(out.select(*keys, TIME, *names), tuple(names), tuple(keys))

    from_any = of

    @classmethod
    def from_arrays(cls, spark: SparkSession, time: Iterable, values: Any, columns: Sequence[str] | None = None) -> Series:
        """A series of arrays on the driver; ``time`` holds datetimes or nanoseconds.  Equal times: the first stays."""
        t = pd.to_datetime(np.asarray(time)).values.astype("datetime64[ns]").astype(np.int64) if not np.issubdtype(np.asarray(time).dtype, np.integer) else np.asarray(time, np.int64)
        x = np.asarray(values, float).reshape(len(t), -1)
        names = list(columns) if columns is not None else ["value"] if x.shape[1] == 1 else [f"value_{i}" for i in range(x.shape[1])]
        if len(names) != x.shape[1] or len(set(names)) != len(names):
            raise ValueError(f"{x.shape[1]} columns need as many distinct names")
        order = np.argsort(t, kind="stable")
        t, x = t[order], x[order]
        first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        rows = [(int(a), *[None if np.isnan(v) else float(v) for v in b]) for a, b in zip(t[first], x[first], strict=True)]
        schema = T.StructType([T.StructField(TIME, T.LongType(), False), *[T.StructField(c, T.DoubleType()) for c in names]])
        return cls(spark.createDataFrame(rows, schema), tuple(names))

    # order and shape

    @property
    def by_key(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def ordered(self) -> WindowSpec:
        return self.by_key.orderBy(TIME)

    @property
    def axis(self) -> tuple[str, ...]:
        return (*self.keys, TIME)

    def with_values(self, columns: dict[str, Column], df: DataFrame | None = None) -> Series:
        """The same axis with other values, all computed in one projection."""
        out = (self.df if df is None else df).select(*self.axis, *self.carry, *[c.alias(n) for n, c in columns.items()])
        return Series(out, tuple(columns), self.keys, self.carry)

    wrap = with_values

    def select(self, *names: str) -> Series:
        missing = [n for n in names if n not in self.values]
        if missing:
            raise KeyError(f"no such columns: {', '.join(missing)}")
        return Series(self.df.select(*self.axis, *names), names, self.keys)

    def iter_columns(self) -> Iterable[Series]:
        return (self.select(c) for c in self.values)

    __getitem__ = select

    def rename(self, names: dict[str, str]) -> Series:
        return self.with_values({names.get(c, c): F.col(c) for c in self.values})

    def join(self, *others: Series) -> Series:
        """All columns on the union of the axes; null where a series has no such time."""
        out = self
        for other in others:
            if other.keys != self.keys:
                raise ValueError("joined series need equal keys")
            if twice := set(out.values) & set(other.values):
                raise ValueError(f"duplicate columns: {', '.join(sorted(twice))}")
            out = Series(out.df.join(other.df, [*self.axis], "full_outer"), (*out.values, *other.values), self.keys)
        return out

    def complete_rows(self) -> Series:
        return replace(self, df=self.df.dropna(how="any", subset=list(self.values)))

    def persisted(self) -> Series:
        return replace(self, df=self.df.persist())

    # one long series over many tasks

    def in_chunks(self, chunk: Any, before: Any = 0, after: Any = 0) -> Series:
        """The series cut into pieces of time, each with copies of the rows up to ``before`` and ``after`` it.

        Each piece is a series of its own, so that windows no longer than these margins give the same values as over the
        whole, but in as many tasks as there are pieces.  :meth:`out_of_chunks` drops the copies."""
        size, low, high = (x if isinstance(x, int) else parse_duration(x) for x in (chunk, before, after))
        t = F.col(TIME)
        pieces = F.sequence(F.floor((t - high) / size), F.floor((t + low) / size))
        return Series(self.df.withColumn("chunk", F.explode(pieces)), self.values, (*self.keys, "chunk"), self.carry)

    def out_of_chunks(self, chunk: Any) -> Series:
        size = chunk if isinstance(chunk, int) else parse_duration(chunk)
        own = self.df.where(F.col("chunk") == F.floor(F.col(TIME) / size)).drop("chunk")
        return Series(own, self.values, tuple(k for k in self.keys if k != "chunk"), self.carry)

    # frequency

    def with_step(self, name: str = "__step") -> DataFrame:
        """``df`` with the series' constant step, null where it has none (under three rows, or uneven times)."""
        gap = F.col(TIME) - F.lag(TIME).over(self.ordered)
        df = self.df.withColumn("__gap", gap)
        low, high, n = (f.over(self.by_key) for f in (F.min("__gap"), F.max("__gap"), F.count(F.lit(1))))
        return df.withColumn(name, F.when((low == high) & (n >= 3), low)).drop("__gap")

    @cached_property
    def freq(self) -> int | None:
        """The step that all series share, in nanoseconds; None if there is none."""
        gap = F.col(TIME) - F.lag(TIME).over(self.ordered)
        per = self.df.select(*self.keys, gap.alias("g")).groupBy(*self.keys).agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("n"))
        r = per.agg(F.min("low"), F.max("high"), F.min("n")).first()
        return r[0] if r and r[0] is not None and r[0] == r[1] and r[2] >= 3 else None

    def required_freq(self, who: str) -> int:
        if self.freq is None:
            raise ValueError(f"{who} needs evenly spaced times, three at least; resample first")
        return self.freq

    # per-series Python

    def per_series(self, function: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], names: Sequence[str]) -> Series:
        """Apply a numerical function of a whole series (times and values, NaN for missing) in a task of its own."""
        keys, values = list(self.keys), list(self.values)
        schema = T.StructType([*[self.df.schema[k] for k in keys], T.StructField(TIME, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(TIME, kind="stable")
            out = function(pdf[TIME].to_numpy(), {c: pdf[c].to_numpy(float, na_value=np.nan) for c in values})
            new = {n: pd.array(np.where(np.isnan(out[n]), 0.0, out[n]), "Float64") for n in names}
            for n in names:
                new[n][np.isnan(out[n])] = pd.NA
            return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, TIME: pdf[TIME].to_numpy(), **new})

        grouped = self.df.groupBy(*keys) if keys else self.df.groupBy(F.lit(0).alias("__all"))
        return Series(grouped.applyInPandas(run, schema), tuple(names), self.keys)

    # egress

    def to_frame(self, time: str | None = None) -> DataFrame:
        """The DataFrame; with ``time``, a timestamp column of that name stands for the nanoseconds."""
        if time is None:
            return self.df
        return self.df.select(*self.keys, F.timestamp_micros(F.floor(F.col(TIME) / 1000)).alias(time), *self.values)

    to_native = to_frame

    def to_numpy(self) -> np.ndarray:
        pdf = self.df.orderBy(*self.axis).toPandas()
        return pdf[list(self.values)].to_numpy(float, na_value=np.nan)

    def column_values(self, name: str) -> np.ndarray:
        return self.select(name).to_numpy()[:, 0]


def validate_series(data: DataFrame, **options: Any) -> DataFrame:
    """Sorted out: one row per time, times in nanoseconds, values double, NaN as null."""
    return Series.of(data, **options).df


def resampled(df: DataFrame, time: str, every: str, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> Series:
    """Input preparation: aggregates per calendar unit (``date_trunc``) as a series with unique times."""
    out = df.groupBy(*keys, F.date_trunc(every, F.col(time)).alias("__t")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return Series.of(out, time="__t", keys=keys, values=list(aggregates), unique=True)
