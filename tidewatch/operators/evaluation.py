"""How good labels, events and scores are."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.events import END, START, Events, to_events
from tidewatch.sources.series import TIME, Series

Number = float | None | dict[str, float | None]


def ratio(a: float | None, b: float | None) -> float | None:
    return None if not b else (a or 0) / b


def paired(y_true: Any, y_pred: Any) -> Series:
    """Truth and prediction side by side; their axes must be the same."""
    t, p = Series.of(y_true), Series.of(y_pred)
    if len(t.values) == 1 and len(p.values) == 1:
        p = p.rename({p.values[0]: t.values[0]})
    if set(t.values) != set(p.values):
        raise ValueError("truth and prediction need equal columns")
    marks = (t.with_values({**{f"t_{c}": F.col(c) for c in t.values}, "t_there": F.lit(1.0)}), p.with_values({**{f"p_{c}": F.col(c) for c in t.values}, "p_there": F.lit(1.0)}))
    both = marks[0].join(marks[1])
    for side in ("t_there", "p_there"):
        there = F.when(F.col(side).isNull(), F.raise_error(F.lit("truth and prediction stand on different times")).cast("double")).otherwise(F.col(side))
        both = both.with_values({**{c: F.col(c) for c in both.values}, side: there})
    return both


def point_counts(y_true: Any, y_pred: Any) -> dict[str, dict[str, int]]:
    """Anomalous samples in truth, prediction, both and either; one job for all columns."""
    names = Series.of(y_true).values
    both = paired(y_true, y_pred)
    one = lambda c: F.coalesce(F.col(c) >= 1, F.lit(False))
    sums: list[Column] = [F.max(F.col("t_there") + F.col("p_there"))]
    for c in names:
        t, p = one(f"t_{c}"), one(f"p_{c}")
        sums += [F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (t, p, t & p, t | p)]
    row = both.df.agg(*sums).first()
    return {c: dict(zip(("true", "pred", "both", "either"), row[1 + 4 * i : 5 + 4 * i], strict=True)) for i, c in enumerate(names)}


def one_or_all(found: dict[str, float | None]) -> Number:
    return next(iter(found.values())) if len(found) == 1 else found


def overlaps(y_true: Events, y_pred: Events) -> DataFrame:
    """Each true event with the time that predictions cover of it and the first such moment.

    The parts common to both are told to their owners by an ordered scan: the last true event that starts by then."""
    common = y_true.intersect(y_pred)
    owner = y_true.df.select(*y_true.by, F.col(START).alias("p"), F.lit(0).alias("k"), START, END, F.lit(None).cast("long").alias("from"), F.lit(0).cast("long").alias("span"))
    part = common.df.select(*y_true.by, F.col(START).alias("p"), F.lit(1).alias("k"), F.lit(None).cast("long").alias(START), F.lit(None).cast("long").alias(END), F.col(START).alias("from"), (F.col(END) - F.col(START) + 1).alias("span"))
    w = Window.partitionBy(*y_true.by).orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)
    told = owner.unionAll(part).select(*y_true.by, F.max(START).over(w).alias("s"), F.max(END).over(w).alias("e"), "from", "span")
    return told.groupBy(*y_true.by, F.col("s").alias(START), F.col("e").alias(END)).agg(F.sum("span").alias("covered"), F.min("from").alias("first"))


def event_recall(y_true: Events, y_pred: Events, thresh: float) -> float | None:
    hit = F.col("covered") >= F.lit(float(thresh)) * (F.col(END) - F.col(START) + 1)
    n, k = overlaps(y_true, y_pred).agg(F.count(F.lit(1)), F.sum(((F.col("covered") > 0) & hit).cast("long"))).first()
    return ratio(k, n)


def kinds(y_true: Any, y_pred: Any) -> str:
    found = {"dict" if isinstance(y, dict) else "events" if isinstance(y, Events) else "labels" for y in (y_true, y_pred)}
    if len(found) > 1:
        raise TypeError("truth and prediction must be of one kind: labels, events, or dicts of events")
    return found.pop()


def per_name(function: Any, y_true: dict, y_pred: dict, *args: Any) -> dict:
    if set(y_true) != set(y_pred):
        raise ValueError("truth and prediction need equal names")
    return {k: function(y_true[k], y_pred[k], *args) for k in y_true}


def recall(y_true: Any, y_pred: Any, thresh: float = 0.5) -> Number:
    """Share of the truth that is found: samples for labels; for events, those covered to the share ``thresh``."""
    kind = kinds(y_true, y_pred)
    if kind == "dict":
        return per_name(recall, y_true, y_pred, thresh)
    if kind == "events":
        return event_recall(y_true, y_pred, thresh)
    return one_or_all({c: ratio(n["both"], n["true"]) for c, n in point_counts(y_true, y_pred).items()})


def precision(y_true: Any, y_pred: Any, thresh: float = 0.5) -> Number:
    """Share of the predictions that are true: recall the other way round."""
    if kinds(y_true, y_pred) == "labels":
        return one_or_all({c: ratio(n["both"], n["pred"]) for c, n in point_counts(y_true, y_pred).items()})
    return recall(y_pred, y_true, thresh)


def f1_score(y_true: Any, y_pred: Any, recall_thresh: float = 0.5, precision_thresh: float = 0.5, *, disjoint: float | None = None) -> Number:
    """Harmonic mean of recall and precision; where that has no value although something is anomalous, ``disjoint``."""
    if kinds(y_true, y_pred) == "labels":
        return one_or_all({c: ratio(2 * n["both"], n["true"] + n["pred"]) if n["both"] else disjoint if n["either"] else None for c, n in point_counts(y_true, y_pred).items()})
    r, p = recall(y_true, y_pred, recall_thresh), precision(y_true, y_pred, precision_thresh)
    return {k: harmonic(r[k], p[k], disjoint) for k in r} if isinstance(r, dict) else harmonic(r, p, disjoint)


def harmonic(r: float | None, p: float | None, disjoint: float | None = None) -> float | None:
    if r is None and p is None:
        return None
    return disjoint if r is None or p is None or r + p == 0 else 2 * r * p / (r + p)


def iou(y_true: Any, y_pred: Any) -> Number:
    """Common over joint samples, or durations."""
    kind = kinds(y_true, y_pred)
    if kind == "dict":
        return per_name(iou, y_true, y_pred)
    if kind == "events":
        return ratio(y_true.intersect(y_pred).total_duration, y_true.union(y_pred).total_duration)
    return one_or_all({c: ratio(n["both"], n["either"]) for c, n in point_counts(y_true, y_pred).items()})


def events_of(y: Any) -> Events:
    return y if isinstance(y, Events) else to_events(y)


def detection_delays(y_true: Any, y_pred: Any) -> DataFrame:
    """Per true event the nanoseconds until a prediction first covers it; null if none does."""
    return overlaps(events_of(y_true), events_of(y_pred)).withColumn("delay", F.col("first") - F.col(START)).drop("covered", "first")


def detection_delay(y_true: Any, y_pred: Any, *, statistic: str = "mean") -> float | None:
    """Mean, median or largest delay of the events that are detected."""
    if statistic not in ("mean", "median", "max"):
        raise ValueError("statistic is mean, median or max")
    function = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "max": F.max}[statistic]
    value = detection_delays(y_true, y_pred).agg(function("delay")).first()[0]
    return None if value is None else float(value)


def scored_pairs(y_true: Any, scores: Any) -> tuple[DataFrame, str, str]:
    if isinstance(y_true, Events) or isinstance(scores, Events):
        raise TypeError("ranking needs labels and scores, not events")
    t, s = Series.of(y_true), Series.of(scores)
    both = t.rename({t.values[0]: "y"}).join(s.rename({s.values[0]: "s"}))
    return both.df.where("y IS NOT NULL AND s IS NOT NULL").select((F.col("y") >= 1).cast("long").alias("y"), "s"), "y", "s"


def average_precision(y_true: Any, scores: Any) -> float | None:
    """Precision averaged over recall, stepping down the distinct scores; only their counts are ranked."""
    rows, y, s = scored_pairs(y_true, scores)
    counts = rows.groupBy(s).agg(F.sum(y).alias("hits"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select("hits", "n", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("seen"))
    total, n, area = steps.agg(F.sum("hits"), F.sum("n"), F.sum(F.col("hits") * F.col("tp") / F.col("seen"))).first()
    return None if not total or total == n else area / total


def roc_auc(y_true: Any, scores: Any) -> float | None:
    """Chance that an anomalous sample scores above a normal one, ties counting half."""
    rows, y, s = scored_pairs(y_true, scores)
    counts = rows.groupBy(s).agg(F.sum(y).alias("hits"), F.count(F.lit(1)).alias("n"))
    up = Window.orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("hits", "n", (F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2.0).alias("rank"))
    hits, n, total = ranks.agg(F.sum("hits"), F.sum("n"), F.sum(F.col("hits") * F.col("rank"))).first()
    if not hits or hits == n:
        return None
    return (total - hits * (hits + 1) / 2.0) / (hits * (n - hits))


def cuts(n: int, mode: int, n_splits: int, ratio_: float) -> list[tuple[int, int, int]]:
    """Folds as (first training row, first test row, end).

    1: one cut.  2: consecutive pieces, each cut.  3: growing training, pieces as tests.  4: each piece trains, the next
    tests."""
    if mode == 1:
        found = [(0, round(n * ratio_), n)]
    elif mode == 2:
        size = n // n_splits
        edges = [i * size for i in range(n_splits)] + [n]
        found = [(a, a + round((b - a) * ratio_), b) for a, b in zip(edges, edges[1:], strict=False)]
    elif mode == 3:
        size = n // (n_splits + 1)
        edges = [(i + 1) * size for i in range(n_splits)] + [n]
        found = [(0, a, b) for a, b in zip(edges, edges[1:], strict=False)]
    elif mode == 4:
        size = n // (n_splits + 1)
        edges = [i * size for i in range(n_splits + 1)] + [n]
        found = list(zip(edges, edges[1:], edges[2:], strict=False))
    else:
        raise ValueError("mode is 1, 2, 3 or 4")
    if any(not a < b < c for a, b, c in found):
        raise ValueError(f"{n} rows leave a fold without training or test rows")
    return found


def split_train_test(data: Any, mode: int = 1, n_splits: int = 1, train_ratio: float = 0.7) -> list[tuple[Series, Series]]:
    """Time-ordered folds of one series: (training, test) for each."""
    series = Series.of(data)
    if series.keys:
        raise ValueError("folds are cut from one series")
    if n_splits < 1 or not 0 < train_ratio < 1:
        raise ValueError("there is one split at least, and the ratio is between 0 and 1")
    numbered = series.df.withColumn("__row", F.row_number().over(series.ordered) - 1).persist()
    folds = cuts(numbered.count(), mode, n_splits, train_ratio)
    part = lambda a, b: Series(numbered.where((F.col("__row") >= a) & (F.col("__row") < b)).drop("__row"), series.values)
    return [(part(a, b), part(b, c)) for a, b, c in folds]


def compare(detectors: dict[str, Any], dataset: Any, *, thresh: float = 0.5, fit_on: Any = None) -> list[dict[str, Any]]:
    """Each detector's event recall, precision, f1, number of alerts and mean delay in seconds."""
    out = []
    for name, detector in detectors.items():
        own = detector.clone()
        own.fit(dataset.data if fit_on is None else fit_on)
        found = to_events(own.run(dataset.data))
        r, p = recall(dataset.events, found, thresh), precision(dataset.events, found, thresh)
        delay = detection_delay(dataset.events, found)
        out.append({"detector": name, "recall": r, "precision": p, "f1": harmonic(r, p), "alerts": found.n_events, "delay": None if delay is None else delay / 1e9})
    return out


__all__ = ["average_precision", "compare", "detection_delay", "detection_delays", "f1_score", "iou", "precision", "recall", "roc_auc", "split_train_test", "TIME"]
