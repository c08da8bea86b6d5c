"""Queries against their SQL on odd tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

START = 1_704_067_200  # 2024-01-01


def shown(rows):
    """Rows as a multiset, in which NaN equals itself and not null."""
    return Counter(tuple(repr(v) for v in r) for r in rows)


def answers(spark, folder, name, rows):
    """What a query and its SQL give for events of (event_id, microseconds since START, event_type, value)."""
    duckdb = pytest.importorskip("duckdb")
    from tidewatch import queries

    df = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double")
    df.select("event_id", F.timestamp_micros(F.col("us") + START * 10**6).alias("ts"), "event_type", "value").repartition(3).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    out = queries.QUERIES[name](spark, str(folder))
    want = con.sql(queries.ORACLES[name])
    assert out.columns == want.columns
    return shown(map(tuple, out.collect())), shown(want.fetchall())


def hours_of(counts, value):
    """So many events in each hour, all of one value."""
    return [(1000 * i + j, 3_600_000_000 * i + j, "a", value) for i, n in enumerate(counts) for j in range(n)]


def test_calibration_without_anomalous_hours(spark, tmp_path):
    found, want = answers(spark, tmp_path, "calibration_threshold", hours_of([3, 5, 4, 6, 3, 2], 10.0))  # no mean above 50
    assert found == want and sum(found.values()) == 6
    assert all(row[1] == "None" for row in found)


@pytest.mark.parametrize(
    ("counts", "value", "row"),
    [
        ([16, 18, 3, 17], 10.0, ("0.0", "nan", "0.0", "0.0")),  # no hour's mean is above 50
        ([3, 4, 3, 5], 100.0, ("nan", "0.0", "0.0", "0.0")),  # no hour's count above 15
        ([3, 4, 3, 5], 10.0, ("nan", "nan", "nan", "nan")),
        ([], 10.0, ("None", "None", "None", "None")),
    ],
)
def test_metrics_of_labels_that_flag_nothing(spark, tmp_path, counts, value, row):
    found, want = answers(spark, tmp_path, "metrics_of_labels", hours_of(counts, value))
    assert found == want == Counter([row])


def test_f1_scores_without_anything_in_common(spark):
    import tidewatch as tw

    def labels(*values):
        return tw.Series.from_arrays(spark, list(range(len(values))), [float(v) for v in values])

    none, first, last = labels(0, 0, 0), labels(1, 0, 0), labels(0, 0, 1)
    for t, p in ((none, first), (first, none), (first, last)):
        assert tw.f1_score(t, p) is None and tw.f1_score(t, p, disjoint=0.0) == 0.0
    assert tw.f1_score(none, none, disjoint=0.0) is None and tw.f1_score(first, first) == 1.0
    events = [tw.Events.from_bounds(spark, [(0, 9)]), tw.Events.from_bounds(spark, [(0, 1)]), tw.Events.from_bounds(spark, [(20, 29)])]
    assert tw.f1_score(events[0], events[1]) == 0.0  # recall 0, precision 1
    assert tw.f1_score(events[0], events[2]) is None and tw.f1_score(events[0], events[2], disjoint=0.0) == 0.0


def copies(n, times):
    """Events of two types at every ninth minute, each ``times`` over with other ids and, but for every third, other values."""
    rows = [(i, 540_000_000 * (i // 2), "ab"[i % 2], float(i * 37 % 101) + 0.25 * (i % 2)) for i in range(n)]
    return [(k * n + i, us, kind, v + (k * (i * 7 % 5) if i % 3 else 0)) for k in range(times) for i, us, kind, v in rows]


@pytest.mark.parametrize(
    "name",
    ["detector_fixed", "detector_iqr", "detector_mad", "detector_quantile", *[f"deviation_{c}_{s}" for c in ("mean", "median") for s in ("idr", "iqr", "mad", "std")], "rolling_duration_centred"],
)
def test_events_of_equal_times_stay(spark, tmp_path, name):
    found, want = answers(spark, tmp_path, name, copies(120, 4))
    assert sum(found.values()) == 480
    assert found == want
