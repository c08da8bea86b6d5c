"""The online peaks-over-threshold fence as a stateful stream: one fence per key, carried by the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.operators.thresholds import PotThreshold
from tidewatch.sources.series import TIME


def online_pot(stream: DataFrame, fitted: PotThreshold, key: str, value: str) -> DataFrame:
    """``stream`` (key, t_ns, value) -> ``key, t_ns, value, label``.

    Every key starts from the fitted threshold and goes on by its own values in order of time within each batch.  The
    state is the threshold itself, as JSON."""
    start = json.dumps(fitted.to_dict())
    kind = stream.schema[key].dataType.simpleString()

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = PotThreshold.from_dict(json.loads(state.get[0] if state.exists else start))
        rows = pd.concat(list(parts)).sort_values(TIME, kind="stable")
        labels = [held.update(float("nan") if pd.isna(v) else float(v)) for v in rows[value]]
        state.update((json.dumps(held.to_dict()),))
        yield pd.DataFrame({key: keys[0], TIME: rows[TIME], value: rows[value], "label": [None if x != x else x for x in labels]})

    grouped = stream.select(key, TIME, value).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind}, {TIME} long, {value} double, label double", "threshold string", "append", "NoTimeout")
