"""Hands this package to the executors, for sessions whose workers do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
#: Applications that have the package already.
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application; in local modes only where the path lacks it."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    if context.master.startswith("local") and str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = Path(tempfile.mkdtemp(prefix="tidewatch-"))  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "tidewatch.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((ROOT / "tidewatch").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(folder / "tidewatch.zip"))
