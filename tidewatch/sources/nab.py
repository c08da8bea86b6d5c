"""Files of a public anomaly benchmark: CSV series with a JSON of labelled windows, read from a local copy."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.request
from pathlib import Path

from pyspark.sql import SparkSession

from tidewatch.operators.events import Events
from tidewatch.sources.series import Series
from tidewatch.sources.synthetic import Dataset

WINDOWS = "labels/combined_windows.json"


def fetch(base: str, name: str, cache: Path) -> Path:
    """The cached file; fetched from ``base`` first if it is missing, under a temporary name until it is complete."""
    target = cache / name
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        with urllib.request.urlopen(f"{base}/{name}", timeout=30) as source, tempfile.NamedTemporaryFile(dir=target.parent, delete=False) as out:
            out.write(source.read())
        os.replace(out.name, target)
    return target


def windows(cache_dir: str, download: str | None) -> dict[str, list]:
    cache = Path(cache_dir)
    path = cache / WINDOWS
    if download and not path.exists():
        fetch(download, WINDOWS, cache)
    if not path.exists():
        raise FileNotFoundError(f"{path}: copy the benchmark there, or name where to download it from")
    return json.loads(path.read_text())


def nab_names(cache_dir: str, download: str | None = None) -> list[str]:
    return sorted(windows(cache_dir, download))


def load_nab(spark: SparkSession, name: str, *, cache_dir: str, download: str | None = None) -> Dataset:
    """One series with its labelled windows; ``download`` is an address to fetch missing files from, off by default."""
    known = windows(cache_dir, download)
    found = [k for k in known if k == name or Path(k).stem == name]
    if len(found) != 1:
        raise KeyError(f"{name}: {len(found)} series of that name")
    path = Path(cache_dir) / "data" / found[0]
    if download:
        fetch(download, f"data/{found[0]}", Path(cache_dir))
    df = spark.read.schema("timestamp timestamp_ntz, value double").option("header", True).csv(f"file://{path.resolve()}")
    return Dataset(found[0], Series.of(df, time="timestamp"), Events.from_bounds(spark, [tuple(w) for w in known[found[0]]]), "labelled windows")
