"""Row-by-row Python over Arrow batches: small slices, ids passed through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at one time; rows and bytes of an Arrow batch, where the session names no number.
SLICE, BATCH, BYTES = 128, 1024, 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Keep Arrow batches small, in rows and in bytes, where the session still has Spark's defaults, for texts are long.

    Spark reads these settings when a lazy plan runs, after the call, so they stay set.
    """
    conf, key, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, str(BATCH))
    if int(conf.get(size).rstrip("bB")) == 64 << 20:
        conf.set(size, str(BYTES))


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, values: list[str], through: list[str]) -> DataFrame:
    """Apply Python to ``df``: the columns ``through`` pass unchanged, ``schema`` (DDL) has what the function adds.

    ``make`` runs once a task and returns a function from the lists of ``values`` to the lists of the new columns.
    """
    bounded_batches(df)
    kept = df.select(*through).schema
    out = StructType(kept.fields + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            function = function or make()
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = function(*[part.column(len(through) + i).to_pylist() for i in range(len(values))])
                columns = [part.column(i) for i in range(len(through))]
                columns += [pa.array(new[f.name], f.type) for f in list(arrow)[len(through) :]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

    return df.select(*through, *values).mapInArrow(run, out)
