"""Tables written to the shared folder, so that lineage is cut where every executor can read it again."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewatch.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only in local mode, where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


#: Paths written by :func:`staged` and not yet deleted, oldest first.
_WRITTEN: list[str] = []
#: Those of the pipeline stage that ran last.
_LEFT: list[str] = []


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, safe against lost executors.

    After a ``large`` step its shuffle files are let go of.  What is not dropped before goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if large:
        release(spark)
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    delete(df.sparkSession, df.staged_path)
    _WRITTEN.remove(df.staged_path)


def tidy(stage: Callable) -> Callable:
    """A stage of a pipeline that first deletes what the stage before it staged: its result is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        while _LEFT:
            path = _LEFT.pop()
            delete(spark, path)
            if path in _WRITTEN:
                _WRITTEN.remove(path)
        before = set(_WRITTEN)
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(x for x in _WRITTEN if x not in before)
        return out

    return run
