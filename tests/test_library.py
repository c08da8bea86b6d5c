"""Hand-checked values and contracts of the operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

import tidewatch as tw
from tidewatch.functions import kernels

HOUR = 3600 * 10**9
N = None


def series(spark, values, columns=None, step=HOUR, start="2024-01-01"):
    x = np.array([[math.nan if v is None else v for v in (r if isinstance(r, list | tuple) else [r])] for r in values], float)
    t = pd.Timestamp(start).value + step * np.arange(len(x))
    return tw.Series.from_arrays(spark, t, x, columns or (["x"] if x.shape[1] == 1 else [f"c{i}" for i in range(x.shape[1])]))


def got(out, column=None):
    pdf = out.df.orderBy("t_ns").toPandas()
    return [None if pd.isna(v) else round(float(v), 6) for v in pdf[column or out.values[0]]]


def flagged(out, column=None):
    return [i for i, v in enumerate(got(out, column)) if v == 1.0]


# durations, sources


@pytest.mark.parametrize(("spec", "ns"), [("90s", 90 * 10**9), ("1.5h", 5400 * 10**9), ("d", 86400 * 10**9), ("2 weeks", 14 * 86400 * 10**9), ("5 min", 300 * 10**9), (pd.Timedelta("1us").to_pytimedelta(), 1000)])
def test_durations(spec, ns):
    assert tw.parse_duration(spec) == ns


@pytest.mark.parametrize("spec", ["1h30min", "M", "3mo", "1y", "-1s", "0s", "x", "1 fortnight", ""])
def test_refused_durations(spec):
    with pytest.raises(ValueError, match=r".+"):
        tw.parse_duration(spec)


def test_series_of_a_table(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:02', 2D, 1), (TIMESTAMP_NTZ'2024-01-01 00:00:01', double('NaN'), 1), (TIMESTAMP_NTZ'2024-01-01 00:00:02', 7D, 0) AS t(ts, v, k)")
    s = tw.Series.of(df, values=["v"], order=["k"])
    assert [tuple(r) for r in s.df.orderBy("t_ns").collect()] == [(1704067201 * 10**9, None), (1704067202 * 10**9, 7.0)]
    with pytest.raises(TypeError):
        tw.Series.of(spark.sql("SELECT current_date() AS d, 'a' AS s"))
    with pytest.raises(ValueError, match="time"):
        tw.Series.of(spark.sql("SELECT 1 AS a"))
    even, odd_ = series(spark, [1, 2, 3]), tw.Series.from_arrays(spark, [0, 1, 3], [1, 2, 3])
    assert even.freq == HOUR and odd_.freq is None
    both = even.join(series(spark, [5, 6], ["y"], start="2024-01-01 02:00"))
    assert got(both, "x") == [1, 2, 3, N] and got(both, "y") == [N, N, 5, 6]
    with pytest.raises(ValueError, match="duplicate"):
        even.join(even)


# windows against pandas


@pytest.mark.parametrize("closed", ["right", "left", "both", "neither"])
@pytest.mark.parametrize("window", [3, "5h"])
def test_windows_against_pandas(spark, closed, window):
    rng = np.random.default_rng(42)
    t = np.cumsum(rng.integers(1, 4, 40)) * HOUR
    x = rng.normal(size=40)
    x[[3, 17, 18, 31]] = np.nan
    s = tw.Series.from_arrays(spark, t, x)
    aggs = {"sum": "sum", "mean": "mean", "median": "median", "std": "std", "var": "var", "min": "min", "max": "max", "skew": "skew", "kurt": "kurt"}
    v = F.col("value")
    out = s.with_values({a: tw.rolling(v, s.ordered, window, a, min_periods=1, closed=closed) for a in aggs}).df.orderBy("t_ns").toPandas()
    p = pd.Series(x, index=pd.to_datetime(t)).rolling(window, min_periods=1, closed=closed)
    for a, f in aggs.items():
        want = getattr(p, f)().to_numpy()
        np.testing.assert_allclose(out[a].to_numpy(float, na_value=np.nan), want, rtol=1e-6, atol=1e-9, equal_nan=True)


def test_window_goldens(spark):
    s = series(spark, [1, N, 3, 4])
    assert got(tw.RollingAggregate(2, "count", min_periods=1).transform(s)) == [1, 1, 1, 2]
    s = series(spark, [0, 1, 0, 2, N])
    assert got(tw.RollingAggregate(3, "nnz", min_periods=1).transform(s)) == [0, 1, 1, 2, 1]
    s = series(spark, [1, 1, 2, 2, 3])
    assert got(tw.RollingAggregate(3, "nunique", min_periods=1).transform(s)) == [1, 1, 2, 2, 2]
    q = tw.RollingAggregate(5, "quantile", {"q": [0.25, 0.5]}).transform(s)
    assert q.values == ("q0.25", "q0.5") and got(q, "q0.5")[-1] == 2
    h = tw.RollingAggregate(2, "hist", {"bins": [1, 2, 3]}).transform(s)
    assert h.values == ("[1, 2)", "[2, 3]") and got(h, "[1, 2)") == [N, 2, 1, 0, 0] and got(h, "[2, 3]") == [N, 0, 1, 2, 2]
    s = series(spark, [0, 0, 0, 5, 5, 5])
    assert got(tw.DoubleRollingAggregate(2, "mean", diff="diff").transform(s)) == [N, N, 2.5, 5, 2.5, N]
    late = tw.DoubleRollingAggregate(2, "mean", diff="diff", center=False).transform(s)
    assert got(late) == [N, N, N, 2.5, 5, 2.5]
    by_time = tw.DoubleRollingAggregate("2h", "mean", diff="diff", center=False).transform(s)
    assert got(by_time)[3:5] == [2.5, 5]


def test_features(spark):
    s = series(spark, [1, 2, 3, 4])
    r = tw.Retrospect(2, 1).transform(s)
    assert r.values == ("t-0", "t-1") and got(r, "t-1") == [N, 1, 2, 3]
    assert got(tw.Retrospect(1, 1, -1).transform(s), "t+1") == [2, 3, 4, N]
    z = np.array(got(tw.StandardScale().transform(s)))
    assert abs(z.mean()) < 1e-6 and abs(z.std(ddof=1) - 1) < 1e-5
    assert got(tw.StandardScale().transform(series(spark, [2, 2, 2]))) == [0, 0, 0]
    assert got(tw.SumAll().transform(series(spark, [[1, 2], [3, N]]))) == [3, N]
    x = [0, 1, 0, -1] * 10
    d = tw.SeasonalDecomposition(4).fit(series(spark, x))
    assert got(d.transform(series(spark, [5, 1, 0, -1], start="2024-01-03"))) == [5, 0, 0, 0]
    assert d.seasonal_["x"] == [0, 1, 0, -1]
    assert tw.SeasonalDecomposition().fit(series(spark, np.sin(2 * np.pi * np.arange(96) / 12).tolist())).period_ == {"x": 12}
    with pytest.raises(SparkRuntimeException, match="grid"):
        got(d.transform(series(spark, [1, 2, 3], start="2024-01-03 00:30")))
    line = [[i, 2 * i + 1] for i in range(20)] + [[5, 20]]
    r = tw.RegressionResidual("c1").fit(series(spark, line[:20])).transform(series(spark, line))
    assert r.values == ("residual",) and got(r)[-1] == 9 and max(map(abs, got(r)[:20])) < 1e-6
    rank1 = series(spark, [[i, 2 * i] for i in range(30)])
    assert max(got(tw.PcaReconstructionError(1).fit_transform(rank1))) < 1e-9
    assert tw.PcaProjection(1).fit_transform(rank1).values == ("pc0",)
    rng = np.random.default_rng(0).normal(size=(60, 3))
    wide = series(spark, rng.tolist())
    e, per = tw.PcaReconstructionError(2).fit_transform(wide), tw.PcaColumnError(2).fit_transform(wide)
    c = rng - rng.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2]
    want = ((c - c @ v.T @ v) ** 2).sum(axis=1)
    np.testing.assert_allclose(got(e), want, atol=1e-5)
    np.testing.assert_allclose(np.sum([got(per, c) for c in per.values], axis=0), want, atol=1e-5)
    twice = tw.CustomizedTransformer(lambda s, by: s.with_values({c: F.col(c) * by for c in s.values}), fit_func=lambda s: {"by": 2.0})
    assert got(twice.fit(s).transform(s)) == [2, 4, 6, 8]
    assert got(tw.CustomizedTransformer(lambda x: x - x.mean(), matrix=True).transform(s)) == [-1.5, -0.5, 0.5, 1.5]


def test_scorers_and_thresholds(spark):
    d = tw.DeviationScorer().fit(series(spark, [10, 12, 11, 13, 12, 10]))
    assert d.model_["x"] == {"center": 11.5, "scale": 1.75}
    flat = tw.DeviationScorer("mean", "std").fit(series(spark, [1, 1, 1]))
    assert got(flat.score(series(spark, [1, 2, 0, N]))) == [0, math.inf, -math.inf, N]
    assert got(tw.DeviationScorer("median", "mad").fit_score(series(spark, [1, 2, 3])))[2] == round(1 / kernels.MAD_SCALE, 6)
    x = [1.0, 2, 3, 4, 100, N]
    assert flagged(tw.FixedThreshold(high=4).apply(series(spark, x))) == [4]
    assert got(tw.FixedThreshold(high=4).apply(series(spark, x)))[-1] is None
    assert flagged(tw.QuantileThreshold(high=0.75).fit_apply(series(spark, x))) == [4]
    assert flagged(tw.IqrThreshold(3.0).fit_apply(series(spark, x))) == [4]
    assert flagged(tw.IqrThreshold((None, 0.0)).fit_apply(series(spark, x))) == [4]
    assert flagged(tw.MadThreshold(3.0).fit_apply(series(spark, x))) == [4]
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    y[[20, 90]] = 9, -8
    assert flagged(tw.EsdThreshold(0.05).fit_apply(series(spark, y.tolist()))) == [20, 90]
    e = rng.exponential(1.0, 4000)
    pot = tw.PotThreshold(high=1e-3).fit(series(spark, e.tolist()))
    assert 5 < pot.high_["x"] < 10 and pot.low_["x"] == -math.inf
    again = tw.Configurable.from_dict(json.loads(pot.to_json()))
    assert again.update(50.0) == 1.0 and again.update(1.0) == 0.0 and math.isnan(again.update(math.nan)) and again.high_ == pytest.approx(pot.high_, rel=1e-2)
    with pytest.raises(ValueError, match=r".+"):
        tw.FixedThreshold()
    ar = tw.AutoregressionResidualScorer().fit_score(series(spark, [2.0**i for i in range(12)]))
    assert max(map(abs, got(ar)[1:])) < 1e-6 and got(ar)[0] is None


def test_detectors(spark):
    x = [1.0] * 20
    x[12] = 9.0
    s = series(spark, x)
    assert flagged(tw.SpikeDetector().fit_detect(s)) == [12, 13]
    assert flagged(tw.SpikeDetector(side="positive").fit_detect(s)) == [12]
    assert flagged(tw.SpikeDetector(side="negative").fit_detect(s)) == [13]
    assert flagged(tw.IqrDetector().fit_detect(s)) == [12] and flagged(tw.ThresholdDetector(high=5).detect(s)) == [12]
    rng = np.random.default_rng(0)
    step = np.r_[rng.normal(size=60), 10 + rng.normal(size=60)].tolist()
    assert 60 in flagged(tw.LevelShiftDetector(12).fit_detect(series(spark, step)))
    wild = np.r_[rng.normal(size=100), 12 * rng.normal(size=30), rng.normal(size=100)].tolist()
    assert flagged(tw.VolatilityShiftDetector(20, factor=3.0).fit_detect(series(spark, wild)))
    season = (np.sin(2 * np.pi * np.arange(240) / 24) + 0.05 * rng.normal(size=240)).tolist()
    season[100] += 5
    assert flagged(tw.SeasonalDetector(24, factor=6.0, side="positive").fit_detect(series(spark, season))) == [100]
    assert 100 in flagged(tw.AutoregressionDetector(2, factor=6.0).fit_detect(series(spark, season)))
    two = [[i, 2 * i + 0.01 * rng.normal()] for i in range(100)]
    two[50][1] += 30
    assert flagged(tw.RegressionDetector("c1", factor=8.0).fit_detect(series(spark, two))) == [50]
    out = tw.PcaDetector(1, factor=20.0).fit_detect(series(spark, two))
    assert out.values == ("anomaly",) and flagged(out) == [50]
    blobs = series(spark, [[0.0 + i % 3 * 0.1, 0.0] for i in range(30)] + [[50.0, 50.0], [50.1, 50.0]])
    assert flagged(tw.MinClusterDetector(KMeans(k=2, seed=1)).fit_detect(blobs)) == [30, 31]

    assert flagged(tw.OutlierDetector(Far()).fit_detect(blobs)) == [30, 31]
    assert got(tw.SpikeDetector().fit_detect(series(spark, [N, N, N, N]))) == [N] * 4
    assert flagged(tw.IqrDetector().fit_detect(series(spark, [3.0] * 9))) == []


class Far:
    def fit(self, x):
        self.middle = np.median(x, axis=0)
        return self

    def predict(self, x):
        return np.where(np.abs(x - self.middle).max(axis=1) > 10, -1, 1)


def test_methods(spark):
    z = 10 + np.sin(np.arange(200) * np.pi / 12)
    z[137] = 30
    s = series(spark, z.tolist())
    assert 137 in flagged(tw.HampelDetector(7, 6.0).detect(s)) and 137 in flagged(tw.SpectralResidualDetector(factor=6.0).fit_detect(s))
    assert 137 in flagged(tw.RollingQuantileDetector(24, factor=3.0).fit_detect(s))
    step = series(spark, [0.0] * 50 + [10.0] * 50)
    p = tw.PeltScorer().fit(step)
    assert got(p.score(step))[50] == 10 and sum(v != 0 for v in got(p.score(step))) == 1
    assert flagged(tw.PeltDetector().fit_detect(step)) == [50]
    for m in ("binseg", "window", "dynp", "bottomup"):
        assert flagged(tw.RupturesDetector(m, n_bkps=1).fit_detect(step)) == [50]
    d = np.sin(2 * np.pi * np.arange(400) / 20)
    d[200:220] = np.linspace(3, -3, 20)
    discord = series(spark, d.tolist())
    for k in (tw.MatrixProfileScorer(20), tw.DampScorer(20)):
        out = np.array([np.nan if v is None else v for v in got(k.score(discord))])
        assert 180 <= np.nanargmax(out) < 240
    rng = np.random.default_rng(0)
    season = (5 * np.sin(2 * np.pi * np.arange(240) / 24) + 0.2 * rng.normal(size=240)).tolist()
    season[100] += 12
    assert 100 in flagged(tw.StlDetector(factor=6.0).fit_detect(series(spark, season)))
    assert 100 in flagged(tw.MstlDetector([24, 48], factor=6.0).fit_detect(series(spark, season)))


def brute_profile(x, m):
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    k = math.ceil(m / 4)
    for i in range(len(d)):
        d[i, max(0, i - k) : i + k + 1] = np.inf
    return d.min(1)


def test_kernels_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    np.testing.assert_allclose(kernels.nearest_distances(x, 8), brute_profile(x, 8), atol=1e-6)
    for cost in ("l2", "l1"):
        for _ in range(5):
            y = np.r_[rng.normal(size=9), 4 + rng.normal(size=8), rng.normal(size=7)]
            n, beta = len(y), kernels.default_penalty(y, cost)
            sums = kernels.prefix_costs(y - y.mean())
            one = lambda a, b: kernels.segment_cost(y - y.mean(), sums, np.array([a]), b, cost)[0]  # noqa: B023, E731
            best = [-beta] + [np.inf] * n
            for e in range(2, n + 1):
                best[e] = min((best[a] + one(a, e) + beta for a in range(e - 1) if np.isfinite(best[a])), default=np.inf)
            found = [0, *kernels.pelt(y, cost), n]
            assert sum(one(a, b) + beta for a, b in zip(found, found[1:], strict=False)) - beta == pytest.approx(best[n])
    s, t, r = kernels.stl(np.sin(np.arange(96) / 4) + np.arange(96) * 0.1, 24)
    np.testing.assert_allclose(s + t + r, np.sin(np.arange(96) / 4) + np.arange(96) * 0.1)
    assert kernels.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    shape, scale = kernels.gpd_fit(np.random.default_rng(0).exponential(2.0, 4000))
    assert abs(shape) < 0.06 and abs(scale - 2) < 0.15


def test_ensembles(spark):
    pairs = [(a, b) for a in (1, 0, N) for b in (1, 0, N)]
    s = series(spark, pairs)
    assert got(tw.OrAggregator().aggregate(s)) == [1, 1, 1, 1, 0, N, 1, N, N]
    assert got(tw.AndAggregator().aggregate(s)) == [1, 0, N, 0, 0, 0, N, 0, N]
    assert got(tw.VoteAggregator(0.5).aggregate(s)) == [1, 1, 1, 1, 0, 0, 1, 0, N]
    a, b = series(spark, [1, 2, 2, 4]), series(spark, [10, N, 30, 20])
    assert got(tw.ScoreAggregator("mean", "rank").aggregate(a, b)) == [0, 0.5, 0.75, 0.75]
    assert got(tw.ScoreAggregator("max", "none").aggregate(a, b)) == [10, 2, 30, 20]
    assert got(tw.ScoreAggregator("median", "robust").aggregate(a, b))[1] == 0
    assert got(tw.CustomizedAggregator(lambda cols: cols[0] * cols[1]).aggregate(s))[0] == 1


def test_events(spark):
    labels = series(spark, [0, 1, 1, 0, N, 1])
    e = tw.to_events(labels)
    t0 = pd.Timestamp("2024-01-01").value
    assert e.to_list() == [(t0 + HOUR, t0 + 3 * HOUR - 1), (t0 + 5 * HOUR, t0 + 6 * HOUR - 1)]
    assert tw.to_events(labels, as_periods=False).to_list() == [t0 + HOUR, t0 + 2 * HOUR, t0 + 5 * HOUR]
    assert got(tw.to_labels(e, labels)) == [0, 1, 1, 0, 0, 1]
    a = tw.Events.from_bounds(spark, [(0, 10), (11, 20), (30, 40), (60, 60)])
    b = tw.Events.from_bounds(spark, [(15, 35), (50, 60)])
    assert a.to_list() == [(0, 20), (30, 40), 60] and a.n_events == 3 and a.total_duration == 21 + 11 + 1
    assert a.intersect(b).to_list() == [(15, 20), (30, 35), 60] and a.union(b).to_list() == [(0, 40), (50, 60)]
    assert a.expand(5, 5).to_list() == [(-5, 45), (55, 65)] and tw.expand_events(a, after=10).to_list() == [(0, 50), (60, 70)]
    assert tw.Events.empty(spark).n_events == 0 and a.union(tw.Events.empty(spark)).to_list() == a.to_list()
    with pytest.raises(ValueError, match="ends"):
        tw.Events.from_bounds(spark, [(2, 1)])
    wide = tw.to_events(series(spark, [[1, 0], [0, 1], [0, 1]]))
    assert sorted((r.name, r.end_ns - r.start_ns + 1) for r in wide.df.collect()) == [("c0", HOUR), ("c1", 2 * HOUR)]


def test_evaluation(spark):
    t, p = series(spark, [1, 1, 1, 0, 0]), series(spark, [1, 1, 0, 1, 0])
    assert tw.recall(t, p) == pytest.approx(2 / 3) and tw.precision(t, p) == pytest.approx(2 / 3) and tw.iou(t, p) == 0.5
    assert tw.f1_score(t, series(spark, [1, 0, 0, 1, 0])) == pytest.approx(0.4)
    a = tw.Events.from_bounds(spark, [(0, 9), (20, 29)])
    b = tw.Events.from_bounds(spark, [(4, 12), (28, 29), (50, 51)])
    assert tw.recall(a, b) == 0.5 and tw.recall(a, b, 0.1) == 1.0 and tw.precision(a, b) == pytest.approx(2 / 3)
    assert tw.iou(a, b) == pytest.approx(8 / 25) and tw.detection_delay(a, b) == 6 and tw.detection_delay(a, b, statistic="max") == 8
    y, s = series(spark, [0, 0, 1, 1, N]), series(spark, [0.1, 0.4, 0.35, 0.8, 0.9])
    assert tw.roc_auc(y, s) == 0.75 and tw.average_precision(y, s) == pytest.approx(0.8333333)
    assert tw.roc_auc(series(spark, [0, 0]), series(spark, [1, 2])) is None
    folds = tw.split_train_test(series(spark, list(range(40))), mode=3, n_splits=3)
    assert [(a.df.count(), b.df.count()) for a, b in folds] == [(10, 10), (20, 10), (30, 10)]
    with pytest.raises(ValueError, match="fold"):
        tw.split_train_test(series(spark, [1, 2]), mode=2, n_splits=2)
    with pytest.raises(TypeError):
        tw.recall(a, t)


def test_calibration_and_datasets(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=200)
    x[50:55] = x[120:124] = 5.0
    y = np.zeros(200)
    y[50:55] = y[120:124] = 1
    s, t = series(spark, x.tolist()), series(spark, y.tolist())
    for events in (True, False):
        c = tw.tune_threshold(t, s, candidates=50, events=events)
        assert c.score == 1.0 and c.cut_off < 5 and flagged(c.threshold.apply(s)) == [*range(50, 55), *range(120, 124)]
    assert tw.tune_threshold(t, s, metric=lambda a, b: float(b.n_events == 2), candidates=20).score == 1.0
    b = tw.budget_threshold(s, alerts=2, per="200h")
    assert b.score == 2.0
    data = tw.make_series(spark, "spike", n=600, strength=12, seed=4)
    assert data.events.n_events == 3 and sum(got(data.labels)) == 3
    rows = tw.compare({"spike": tw.SpikeDetector(3, side="positive"), "fixed": tw.ThresholdDetector(high=1e9)}, data)
    assert rows[0]["recall"] == 1.0 and rows[1]["recall"] == 0.0 and rows[1]["alerts"] == 0
    for kind in ("dip", "level_shift", "volatility_shift", "seasonal_break"):
        assert tw.make_series(spark, kind, n=400).events.n_events == 3


def test_compose_and_persistence(spark):
    x = [1.0] * 20
    x[12] = 9.0
    s = series(spark, x)
    p = tw.Pipeline([("scale", tw.StandardScale()), ("iqr", tw.IqrDetector())])
    assert flagged(p.fit_detect(s)) == [12] and p.output_kind == "labels" and list(p.named_steps) == ["scale", "iqr"]
    again = tw.Configurable.from_dict(json.loads(p.to_json()))
    assert flagged(again.detect(s)) == [12]
    with pytest.raises(TypeError):
        p.score(s)
    g = tw.Graph([tw.Node("a", tw.IqrDetector()), tw.Node("b", tw.SpikeDetector()), tw.Node("both", tw.AndAggregator(), ("a", "b"))])
    assert flagged(g.fit_detect(s)) == [12] and set(g.trace(s)) == {"a", "b", "both"} and "a --> both" in g.to_mermaid()
    with pytest.raises(ValueError, match="cycle"):
        tw.Graph([tw.Node("a", tw.IqrDetector(), ("b",)), tw.Node("b", tw.IqrDetector(), ("a",)), tw.Node("c", tw.IqrDetector(), ("a",))])
    with pytest.raises(tw.NotFittedError):
        tw.IqrDetector().detect(s)
    assert repr(tw.IqrDetector(2.0)) == "IqrDetector(factor=2.0)" and repr(tw.IqrDetector()) == "IqrDetector()"


def test_keyed_series_equal_single_ones(spark):
    rng = np.random.default_rng(5)
    parts = {k: rng.normal(size=60) for k in ("a", "b")}
    for k, i in (("a", 20), ("b", 40)):
        parts[k][i] = 15
    rows = [(k, i * HOUR, float(v)) for k, x in parts.items() for i, v in enumerate(x)]
    keyed = tw.Series.of(spark.createDataFrame(rows, "k string, t_ns long, x double"), keys=["k"])
    for d in (tw.SpikeDetector(8), tw.IqrDetector(), tw.EsdDetector(), tw.HampelDetector(), tw.PeltDetector(), tw.SeasonalDetector(6), tw.LevelShiftDetector(5), tw.ScoreDetector(tw.DeviationScorer("median", "mad"), tw.MadThreshold(4.0))):
        out = d.clone().fit_detect(keyed).df.toPandas()
        for k, x in parts.items():
            one = got(d.clone().fit_detect(tw.Series.from_arrays(spark, np.arange(60) * HOUR, x, ["x"])))
            many = out[out.k == k].sort_values("t_ns")["x"]
            assert [None if pd.isna(v) else v for v in many] == one


def test_chunks_give_what_the_whole_gives(spark):
    rng = np.random.default_rng(8)
    t = np.cumsum(rng.integers(1, 9, 300)) * 60 * 10**9
    s = tw.Series.from_arrays(spark, t, rng.normal(size=300))
    scorer = tw.RollingAggregateScorer("30min", "median")
    assert got(scorer.score(s.in_chunks("2h", before="30min")).out_of_chunks("2h")) == got(scorer.score(s))
    d = tw.ScoreDetector(tw.DoubleRollingScorer("1h", "mean"), tw.IqrThreshold(0.5)).fit(s)
    assert got(d.detect(s.in_chunks("3h", before="1h", after="1h")).out_of_chunks("3h")) == got(d.detect(s))


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    from tidewatch.operators import component

    rng = np.random.default_rng(9)
    for x in (rng.normal(size=50_000), np.round(rng.normal(size=20_000), 1), np.ones(20_000), np.arange(30_000.0)):
        s = tw.Series.from_arrays(spark, np.arange(len(x)), x)
        monkeypatch.setattr(component, "LARGE", 1)
        out = component.quantiles(s, {"value": {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.987, "e": 1.0}})["value"]
        np.testing.assert_allclose([out[k] for k in "abcde"], np.quantile(x, [0, 0.25, 0.5, 0.987, 1]), rtol=1e-9, atol=1e-9)


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = (100 + 3 * np.sin(2 * np.pi * np.arange(120) / 24) + rng.normal(0, 0.5, 120)).tolist()
    x[110] = 180
    s = series(spark, x)
    t0, spike = pd.Timestamp("2024-01-01").value, tw.SpikeDetector(12).fit(s)
    cut = t0 + 100 * HOUR
    past, new = (tw.Series(s.df.where(c), s.values) for c in (F.col("t_ns") < cut, F.col("t_ns") >= cut))
    stream = tw.Stream(spike, 24).prime(past)
    assert got(stream.update_many(new)) == got(spike.detect(s))[100:]
    assert stream.update(t0 + 120 * HOUR, 500.0) == 1.0
    with pytest.raises(ValueError, match="later"):
        stream.update(t0 + 120 * HOUR, 1.0)
    with pytest.raises(ValueError, match="ahead|history"):
        tw.Stream(tw.HampelDetector(7), 30).prime(past)
    with pytest.raises(ValueError, match="history"):
        tw.Stream(tw.ScoreDetector(tw.RollingAggregateScorer(20), tw.FixedThreshold(high=100)).fit(s), 10).prime(past)
    found = {}
    step = tw.Stream(spike, 24).foreach_batch(str(tmp_path / "held"), lambda df, i: found.update({r.t_ns: r.x for r in df.collect()}))
    (tmp_path / "in").mkdir()
    s.df.where(F.col("t_ns") < cut).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    s.df.where(F.col("t_ns") >= cut).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    for part in ("a", "b"):
        source = spark.readStream.schema(s.df.schema).parquet(str(tmp_path / "in" / part))
        number = {"a": 0, "b": 1}[part]
        q = source.writeStream.foreachBatch(lambda df, _, n=number: step(df, n)).option("checkpointLocation", str(tmp_path / f"ck{part}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [found[t0 + i * HOUR] for i in range(100, 120)] == got(spike.detect(s))[100:]


def test_online_tails(spark, tmp_path):
    e = np.random.default_rng(2).exponential(1.0, 2000)
    fitted = tw.PotThreshold(high=1e-3, level=0.95).fit(tw.Series.from_arrays(spark, np.arange(2000), e))
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate([1.0, 50.0, None, 0.5])]
    spark.createDataFrame(rows, "k string, t_ns long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t_ns long, v double").parquet(str(tmp_path / "in"))
    q = tw.online_pot(stream, fitted, "k", "v").writeStream.format("memory").queryName("tails").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {(r.k, r.t_ns): r.label for r in spark.table("tails").collect()}
    assert [out["a", i] for i in range(4)] == [out["b", i] for i in range(4)] == [0.0, 1.0, None, 0.0]


def test_benchmark_files_from_a_local_copy(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "data" / "set").mkdir(parents=True)
    (tmp_path / "labels" / "combined_windows.json").write_text(json.dumps({"set/one.csv": [["2024-01-01 01:00:00", "2024-01-01 02:00:00"]], "set/two.csv": []}))
    (tmp_path / "data" / "set" / "one.csv").write_text("timestamp,value\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,9\n2024-01-01 02:00:00,\n")
    assert tw.nab_names(str(tmp_path)) == ["set/one.csv", "set/two.csv"]
    d = tw.load_nab(spark, "one", cache_dir=str(tmp_path))
    assert got(d.data) == [1.5, 9, N] and d.events.n_events == 1 and got(d.labels) == [0, 1, 1]
    with pytest.raises(KeyError):
        tw.load_nab(spark, "none", cache_dir=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        tw.nab_names(str(tmp_path / "empty"))


def test_plot_needs_its_library(spark):
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            tw.plot(series(spark, [1, 2]))


def test_every_query_has_an_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 114


def events_folder(spark, folder, counts):
    """A table of events with so many of them in each hour."""
    rows = [(j, int(pd.Timestamp("2024-01-01").timestamp()) + 3600 * i + j % 3600, "a", float(i % 13 + j % 5)) for i, n in enumerate(counts) for j in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_query_streams_every_hour(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from tidewatch import queries

    counts = [5 + i % 3 for i in range(90)]
    counts[40] = 60  # before the newest day
    sf, answers, update = events_folder(spark, tmp_path, counts), [], tw.Stream.update_many
    monkeypatch.setattr(tw.Stream, "update_many", lambda self, data: (answers.append(update(self, data)), answers[-1])[1])
    out = queries.QUERIES["stream_of_spikes"](spark, sf).collect()
    con = duckdb.connect()
    con.sql(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{sf}/events.parquet/*.parquet'")
    want = dict(con.sql(queries.ORACLES["spike_labels"]).fetchall())
    streamed = [(r.t_ns, r.n) for a in answers for r in a.df.collect()]
    assert len(streamed) == len(want) == 90 and dict(streamed) == want
    assert sum(v == 1.0 for v in want.values()) >= 1
    assert {r.t_ns: r.n for r in out} == dict(con.sql(queries.ORACLES["stream_of_spikes"]).fetchall())


def test_cuts_close_in_on_the_single_largest_scores(spark):
    from tidewatch.operators.calibration import grid

    x = np.random.default_rng(3).permutation(1000).astype(float)
    q = np.r_[np.linspace(0, 1, 10), 1 - np.geomspace(0.5, 1 / 1000, 10)]  # the deep end is one row, whatever their number
    cuts = grid(series(spark, x.tolist()), 20)
    np.testing.assert_allclose(cuts, np.unique(np.quantile(x, q)))
    assert {int((x > c).sum()) for c in cuts} >= {0, 1, 2, 4, 8}


def test_query_tries_every_distinct_count(spark, tmp_path):
    from tidewatch import queries

    out = queries.QUERIES["tune_threshold_events"](spark, events_folder(spark, tmp_path, range(1, 121))).collect()
    assert sorted(r.cut for r in out) == [float(i) for i in range(1, 121)]


def test_searches_for_changes_against_brute_force():
    rng = np.random.default_rng(8)
    for cost in ("l2", "l1"):
        y = np.r_[rng.normal(size=8), 3 + rng.normal(size=7), rng.normal(size=9) - 2]
        n, c = len(y), y - y.mean()
        one = lambda a, b: ((c[a:b] - c[a:b].mean()) ** 2).sum() if cost == "l2" else np.abs(c[a:b] - np.median(c[a:b])).sum()  # noqa: B023, E731
        total = lambda cuts: sum(one(a, b) for a, b in zip([0, *cuts], [*cuts, n], strict=True))  # noqa: B023, E731
        able = [(a, b) for a in range(2, n - 3) for b in range(a + 2, n - 1)]
        assert kernels.search_changes(y, "dynp", cost, n_bkps=2) == list(min(able, key=total))
        cuts = []  # binary segmentation: the cut that saves most, again and again
        for _ in range(3):
            edges = [0, *sorted(cuts), n]
            more = [(one(a, b) - one(a, k) - one(k, b), k) for a, b in zip(edges, edges[1:], strict=False) for k in range(a + 2, b - 1)]
            cuts.append(max(more)[1])
        assert kernels.search_changes(y, "binseg", cost, n_bkps=3) == sorted(cuts)
        edges = [0, *range(2, n - 1, 2), n]  # bottom up: the joint that costs least goes, again and again
        while len(edges) > 4:
            extra = [one(a, d) - one(a, b) - one(b, d) for a, b, d in zip(edges, edges[1:], edges[2:], strict=False)]
            del edges[1 + int(np.argmin(extra))]
        assert kernels.search_changes(y, "bottomup", cost, n_bkps=2) == edges[1:-1]
        half = 6  # sliding window: the largest gains that are not too near one another
        gains = sorted(((-(one(k - half, k + half) - one(k - half, k) - one(k, k + half)), k) for k in range(half, n - half + 1)))
        chosen = []
        for _, k in gains:
            if len(chosen) < 2 and all(abs(k - x) >= half for x in chosen):
                chosen.append(k)
        assert kernels.search_changes(y, "window", cost, n_bkps=2, width=12) == sorted(chosen)


def test_deviates_against_brute_force():
    assert kernels.esd_critical(54, 0.05) == pytest.approx(3.159, abs=2e-3)  # as published for this size
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.r_[rng.normal(size=40), rng.normal(size=3) * 12]
        left = x.tolist()
        while len(left) >= 3:
            m, sd = np.mean(left), np.std(left, ddof=1)
            far = max(left, key=lambda v: abs(v - m))  # noqa: B023
            if abs(far - m) / sd <= kernels.esd_critical(len(left), 0.05):
                break
            left.remove(far)
        n, total, squares = kernels.esd_survivors(x, 0.05)
        assert n == len(left) and total == pytest.approx(sum(left)) and squares == pytest.approx(sum(v * v for v in left))


def test_past_only_profile_spectrum_and_loess_against_brute_force():
    rng = np.random.default_rng(5)
    x, m = rng.normal(size=70), 6
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
    want = [min((np.sqrt(((z[i] - z[j]) ** 2).sum()) for j in range(i - m + 1)), default=np.inf) for i in range(len(z))]
    np.testing.assert_allclose(kernels.nearest_distances(x, m, left=True), want, atol=1e-6)

    n, look = 60, 21
    y = np.r_[x[:n], [x[n - 1 - look + 1] + look * np.mean([(x[n - 1] - x[n - 1 - k]) / k for k in range(1, look + 1)])] * 5]
    f = np.array([sum(v * np.exp(-2j * np.pi * j * k / len(y)) for j, v in enumerate(y)) for k in range(len(y))])
    mean = lambda v, k: np.array([np.mean(v[max(0, i - k + 1) : i + 1]) for i in range(len(v))])
    log = np.log(np.abs(f))
    g = np.exp(log - mean(log, 3)) * f / np.abs(f)
    s = np.array([abs(sum(v * np.exp(2j * np.pi * j * k / len(y)) for j, v in enumerate(g)) / len(y)) for k in range(n)])
    np.testing.assert_allclose(kernels.spectral_residual(x[:n]), s / mean(s, 21) - 1, atol=1e-8)

    t, q = np.arange(70.0), 11
    for at in (0.0, 3.5, 40.0, 69.0):
        near = np.argsort(np.abs(t - at), kind="stable")[:q]
        low = min(max(int(np.ceil(at - q / 2)), 0), 70 - q)
        near = np.arange(low, low + q)
        d = np.abs(t[near] - at) / np.abs(t[near] - at).max()
        line = np.polyfit(t[near], x[near], 1, w=np.sqrt(np.clip(1 - d**3, 0, None) ** 3))
        assert kernels.loess(x, q, np.ones(70), np.array([at]))[0] == pytest.approx(np.polyval(line, at))


def test_tails_of_keys_and_events_of_lists(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i * 10**9, float(v)) for k in ("a", "b") for i, v in enumerate(rng.exponential(1.0 + (k == "b"), 1500))]
    keyed = tw.Series.of(spark.createDataFrame(rows, "k string, t_ns long, x double"), time="t_ns", keys=["k"])
    fences = {r.k: r.x__high for r in tw.PotThreshold(high=1e-3, level=0.95).fit(keyed).fences_.collect()}
    for k in ("a", "b"):
        one = tw.Series.of(spark.createDataFrame([r[1:] for r in rows if r[0] == k], "t_ns long, x double"), time="t_ns")
        assert fences[k] == pytest.approx(tw.PotThreshold(high=1e-3, level=0.95).fit(one).fences_["x"]["high"])
    want = [(0, 20), (40, 50)]
    for data in ([(10, 20), (0, 12), (40, 50)], ((40, 50), (0, 20)), np.array([[0, 20], [40, 50]])):
        assert sorted(map(tuple, tw.Events.from_any(data).to_frame().collect())) == want
    assert tw.Events.from_any([]).n_events == 0
