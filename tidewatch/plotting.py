"""A picture of a series with its events; needs matplotlib, and series small enough to look at."""

from __future__ import annotations

from typing import Any

import pandas as pd

from tidewatch.operators.events import Events, to_events
from tidewatch.sources.series import TIME, Series


def plot(series: Any, *, anomaly: Any = None, score: Any = None, axes: Any = None, figsize: tuple = (12, 3), alpha: float = 0.3, title: str | None = None) -> Any:
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("plotting needs matplotlib") from e
    tables = [x.df.orderBy(TIME).toPandas() for x in (Series.of(s) for s in (series, score) if s is not None)]
    if axes is None:
        _, axes = plt.subplots(len(tables), 1, figsize=(figsize[0], figsize[1] * len(tables)), sharex=True, squeeze=False)
        axes = axes[:, 0]
    for ax, pdf in zip(axes, tables, strict=True):
        t = pd.to_datetime(pdf[TIME])
        for c in pdf.columns:
            if c != TIME:
                ax.plot(t, pdf[c], label=c)
        ax.legend()
    if anomaly is not None:
        events = anomaly if isinstance(anomaly, Events) else to_events(anomaly)
        for r in events.df.collect():
            for ax in axes:
                ax.axvspan(pd.to_datetime(r.start_ns), pd.to_datetime(r.end_ns), alpha=alpha, color="red")
    if title:
        axes[0].set_title(title)
    return axes
