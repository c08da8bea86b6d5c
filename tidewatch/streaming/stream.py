"""A fitted component over a stream, one answer per row.

Every row is judged by the component run on the rows up to and including it, as far back as ``history`` goes: its last
answer is the row's.  A batch of rows is one Spark job: each new row becomes a probe, a key of its own over the rows that
it may see, and the component runs on all probes at once.  In Structured Streaming, ``foreach_batch`` is the sink: it
keeps the retained rows as a table in a folder, a new one per batch, so that a batch that is replayed gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import parse_duration
from tidewatch.operators.component import Component, NotFittedError
from tidewatch.sources.series import TIME, Series

#: Shares of the history at which a component is tried on less than all of it.
TRIED = (0.9, 0.8, 0.7, 0.6)


class Stream:
    """``history`` is a number of rows (two or more) or a duration; a row is in reach of itself."""

    def __init__(self, component: Component, history: Any):
        if not component.fitted:
            raise NotFittedError("a stream needs a fitted component")
        if isinstance(history, int) and history < 2:
            raise ValueError("the history has two rows at least")
        self.component, self.history = component, history
        self.span = None if isinstance(history, int) else parse_duration(history)
        self.held: Series | None = None

    # one job for all probes

    def _probes(self, rows: Series, asked: DataFrame) -> Series:
        """``rows`` seen from each asked time: a series per probe."""
        row = F.row_number().over(rows.ordered)
        # how many rows that follow still see this one
        reach = F.lit(self.history - 1) if self.span is None else F.count(F.lit(1)).over(rows.ordered.rangeBetween(0, self.span)).cast("int") - 1
        numbered = rows.df.withColumn("__row", row).withColumn("__reach", reach)
        probes = numbered.join(asked.select(*rows.axis), list(rows.axis), "left_semi")
        probes = probes.select(*rows.keys, F.col("__row").alias("__probe"), F.col(TIME).alias("probe"))
        seen = numbered.withColumn("__probe", F.explode(F.sequence(F.col("__row"), F.col("__row") + F.col("__reach"))))
        at = seen.join(probes, [*rows.keys, "__probe"])
        return Series(at.select(*rows.keys, "probe", TIME, *rows.values), rows.values, (*rows.keys, "probe"))

    def _answers(self, rows: Series, asked: DataFrame) -> Series:
        probes = self._probes(rows, asked)
        out = self.component.run(probes)
        last = out.df.where(F.col(TIME) == F.col("probe")).select(*rows.keys, TIME, *out.values)
        return Series(last, out.values, rows.keys)

    def _retained(self, rows: Series) -> Series:
        if self.span is not None:
            newest = F.max(TIME).over(rows.by_key)
            kept = rows.df.withColumn("__newest", newest).where(F.col(TIME) >= F.col("__newest") - self.span).drop("__newest")
        else:
            back = F.row_number().over(rows.by_key.orderBy(F.desc(TIME)))
            kept = rows.df.withColumn("__back", back).where(F.col("__back") <= self.history).drop("__back")
        return Series(kept, rows.values, rows.keys)

    # one series on the driver

    def prime(self, data: Any, *, check: bool = True) -> Stream:
        """Start from past rows.  With ``check``, the newest row and some before it are judged both by the whole history
        and by what a stream would see then; a component that looks ahead, or needs more history, is refused."""
        rows = Series.of(data)
        if check:
            if rows.keys:
                raise ValueError("a component is checked on one series")
            n = rows.df.count()
            times = [r[0] for r in rows.df.select(TIME).orderBy(TIME).collect()]
            at = sorted({n - 1, *[int(n * s) - 1 for s in TRIED if int(n * s) >= 2]})
            asked = rows.df.sparkSession.createDataFrame([(times[i],) for i in at if i >= 0], f"{TIME} long")
            live = self._answers(rows, asked).df.orderBy(TIME).toPandas()
            batch = self.component.run(rows).df.join(asked, TIME, "left_semi").orderBy(TIME).toPandas()
            names = [c for c in live.columns if c != TIME]
            same = [np.allclose(live[c].to_numpy(float, na_value=np.nan), batch[c].to_numpy(float, na_value=np.nan), equal_nan=True) for c in names]
            if not all(same):
                a, b = (x[names].to_numpy(float, na_value=np.nan) for x in (live, batch))
                off = ~np.isclose(a, b, equal_nan=True).all(axis=1)
                if off[-1]:
                    raise ValueError("the newest row needs more history than the stream keeps")
                raise ValueError("the component looks ahead: earlier answers depend on later rows")
        self.held = self._local(self._retained(rows))
        return self

    @staticmethod
    def _with_newest(rows: DataFrame, held: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """``rows`` with the newest time held of their series, null for a series that is new."""
        newest = held.groupBy(*keys).agg(F.max(TIME).alias("__newest"))
        if keys:
            return rows.join(newest, list(keys), "left")
        found = newest.first()
        return rows.withColumn("__newest", F.lit(found[0] if found else None).cast("long"))

    @staticmethod
    def _local(rows: Series) -> Series:
        """The bounded history as a table of its own, cut off from what it came from."""
        spark = rows.df.sparkSession
        return Series(spark.createDataFrame(rows.df.collect(), rows.df.schema), rows.values, rows.keys)

    def update_many(self, data: Any) -> Series:
        """Answers to new rows, whose times must rise and follow those before."""
        rows = Series.of(data)
        if self.held is None:
            merged = rows
        else:
            if set(rows.values) != set(self.held.values):
                raise ValueError("new rows need the history's columns")
            late = self._with_newest(rows.df, self.held.df, rows.keys)
            if late.where(F.col(TIME) <= F.col("__newest")).take(1):
                raise ValueError("a row is not later than those before it")
            merged = Series(self.held.df.unionByName(rows.df), rows.values, rows.keys)
        out = self._answers(merged, rows.df.select(*rows.keys, TIME))
        out = self._local(out)
        self.held = self._local(self._retained(merged))
        return out

    def update(self, time: Any, values: Any) -> float | None | dict[str, float | None]:
        """Answer to one row."""
        spark: SparkSession = SparkSession.getActiveSession()
        names = self.held.values if self.held is not None else ("value",)
        x = [values[n] for n in names] if isinstance(values, dict) else list(np.atleast_1d(values))
        if len(x) != len(names):
            raise ValueError(f"a row has {len(names)} values")
        out = self.update_many(Series.from_arrays(spark, [time], [x], names))
        r = out.df.first()
        found = {c: r[c] for c in out.values}
        return found if len(found) > 1 else next(iter(found.values()))

    @property
    def buffer(self) -> Series | None:
        return self.held

    # Structured Streaming

    def foreach_batch(self, folder: str, sink: Callable[[DataFrame, int], None], late: str = "raise", **columns: Any) -> Callable[[DataFrame, int], None]:
        """A function for ``writeStream.foreachBatch``.

        Batch ``i`` reads the rows that batch ``i - 1`` left in ``folder`` (any shared file system) and leaves its own;
        both depend on the batch alone, so a replay is harmless.  ``sink`` gets the answers.  Rows that are not later
        than those retained raise, or with ``late="drop"`` (an extension) are left out.
        """
        if late not in ("raise", "drop"):
            raise ValueError("late is raise or drop")

        def run(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            rows = Series.of(batch, **columns)
            old = f"{folder}/{number - 1}"
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            merged, fresh = rows, rows.df
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                held = spark.read.schema(rows.df.schema).parquet(old)
                known = self._with_newest(fresh, held, rows.keys)
                is_late = F.coalesce(F.col(TIME) <= F.col("__newest"), F.lit(False))
                if late == "raise":
                    checked = F.when(is_late, F.raise_error(F.lit("a row is not later than those before it")).cast("long")).otherwise(F.col(TIME))
                    fresh = known.withColumn(TIME, checked).select(*rows.df.columns)
                else:
                    fresh = known.where(~is_late).select(*rows.df.columns)
                merged = Series(held.unionByName(fresh), rows.values, rows.keys)
            sink(self._answers(merged, fresh.select(*rows.keys, TIME)).df, number)
            self._retained(merged).df.write.mode("overwrite").parquet(f"{folder}/{number}")

        return run
