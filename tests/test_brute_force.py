"""Queries that SQL doesn't express, against plain versions in NumPy and Python, on the smallest tables; and the cases that they stand for."""

import math
import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gazeflow.operators import detect, graph, intervals, kernels, kinematics, study, timing, traces
from gazeflow.plans import catalog, common
from gazeflow.series import SERIES, Axis


@pytest.fixture(scope="module")
def frame(spark, small):
    return common.samples(spark, small).toPandas().sort_values(["series", "t", "pos"]).reset_index(drop=True)


def run(spark, small, name):
    return catalog.queries()[name](spark, small).toPandas()


def multi_lag(v, dt, half):
    out = np.full(len(v), np.nan)
    for i in range(1, len(v)):
        top = bottom = 0.0
        for h in range(1, half + 1):
            if i - h >= 0 and i + h < len(v) and np.isfinite(v[i + h] - v[i - h]):
                top, bottom = top + v[i + h] - v[i - h], bottom + 2 * h
        if bottom:
            out[i] = top / (bottom * dt)
    return out


def speeds(g):
    x, y = multi_lag(g.x.to_numpy(), 0.25, 2), multi_lag(g.y.to_numpy(dtype=float), 0.25, 2)
    return x, y, np.sqrt(x * x + y * y)


def taken(t, v, threshold, apart, most):
    """Peaks by trying each against all taken, grown sample by sample."""
    v = np.where(np.isfinite(v), v, -1.0)
    peaks = [i for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] >= v[i + 1] and v[i] > threshold]
    chosen = []
    for i in sorted(peaks, key=lambda i: (-v[i], i)):
        far = [abs(t[j] - t[i]) for j in chosen]
        if all(d >= apart for d in far) and sum(d <= 0.5 for d in far) < most:
            chosen.append(i)
    out = np.zeros(len(v), bool)
    for i in chosen:
        for step in (-1, 1):
            j = i
            while 0 <= j < len(v) and v[j] > threshold:
                out[j] = True
                j += step
    return out


def test_om_votes(spark, small, frame):
    got = run(spark, small, "om_votes").set_index("event_id").om
    for _, g in frame.groupby("series"):
        want = taken(g.t.to_numpy(), speeds(g)[2], 120.0, 7200.0, 2)
        assert got.loc[g.event_id].tolist() == want.tolist()


def runs_of(flag):
    edges = [0, *(i for i in range(1, len(flag)) if flag[i] != flag[i - 1]), len(flag)]
    return [(a, b) for a, b in pairwise(edges) if b > a]


def sized(flag, least):
    out = flag.copy()
    for a, b in runs_of(flag):
        if flag[a] and b - a < least:
            out[a:b] = False
    return out


def threshold(v, start, c):
    v, now = v[np.isfinite(v)], start
    for _ in range(1000):
        below = v[v < now]
        if not len(below):
            return now, np.nan
        new, onset = below.mean() + c * below.std(), below.mean() + 3 * below.std()
        new = new or now
        if abs(new - now) <= 1:
            return new, onset
        now = new
    raise AssertionError


def events_by_hand(g, p):
    t, x, y = g.t.to_numpy(), g.x.to_numpy(dtype=float), g.y.to_numpy(dtype=float)
    xv, yv, v = speeds(g)
    sigma = lambda a: math.sqrt(s) if (s := np.nanmedian(a * a) - np.nanmedian(a) ** 2) > 0 else np.nan
    with np.errstate(invalid="ignore"):
        ek = sized((xv / (p.ek_factor * sigma(xv))) ** 2 + (yv / (p.ek_factor * sigma(yv))) ** 2 > 1, p.ek_least + 1)
        peak, onset = threshold(v, p.nh_start, p.nh_factor)
        grown, core = v > onset, v > peak
    nh = grown.copy()
    for a, b in runs_of(grown):
        if grown[a] and not core[a:b].any():
            nh[a:b] = False
    om = taken(t, v, p.om_threshold, p.om_apart, p.om_most)
    both = (ek.astype(int) + nh + om) / 3 > 0.99 * 2 / 3
    spans = runs_of(both)
    full = both.copy()
    for k, (a, b) in enumerate(spans):
        if not both[a] and 0 < k < len(spans) - 1 and b - a < p.gap:
            full[a:b] = True
    full = sized(full, p.least)
    out = []
    for a, b in runs_of(full):
        if full[a] and b - a > 1:
            size = math.hypot(x[b - 1] - x[a], y[b - 1] - y[a])
            if size > p.min_amplitude:
                out.append(["SACC", t[a], t[b] if b < len(t) else t[-1]])
    gone = np.isnan(x)
    for a, b in runs_of(gone):
        if gone[a]:
            out.append(["BLNK", t[max(a - 1, 0)], t[min(b + 1, len(t) - 1)]])
    wide = sorted((e[1] - p.margin * (e[0] == "BLNK"), e[2] + p.margin * (e[0] == "BLNK"), e[0]) for e in out)
    merged = []
    for a, b, label in wide:
        if merged and a <= merged[-1][1]:
            merged[-1] = [merged[-1][0], max(b, merged[-1][1]), "BLNK"]
        else:
            merged.append([a, b, label])
    merged.sort()
    rows = [(label, a, b) for a, b, label in merged]
    if len(merged) > 1:
        rows += [("ISI", end, m[0]) for end, m in zip([0.0, *(m[1] for m in merged[:-1])], merged, strict=True)]
    return sorted((a, b, label) for label, a, b in rows)


def test_flagship(spark, small, frame):
    got = run(spark, small, "flagship_event_pipeline")
    p = detect.EventParams(dt=0.25, half=2, nh_start=400.0, nh_factor=2.0, om_threshold=120.0, om_apart=7200.0)
    for s, g in frame.groupby("series"):
        mine = got[got.series == s]
        have = sorted(zip(mine.stsec, mine.ensec, mine.label, strict=True))
        want = events_by_hand(g, p)
        assert [h[2] for h in have] == [w[2] for w in want], s
        assert np.allclose([h[:2] for h in have], [w[:2] for w in want], atol=1e-5)


def test_flagship_reads_its_samples_once(spark, small):
    plan = catalog.queries()["flagship_event_pipeline"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan


def test_intersection_recursive(spark, small):
    from gazeflow.plans.q_events import _wide

    got = run(spark, small, "intersection_merge_recursive")

    def solve(events):
        if not events:
            return []
        groups, end = [], -np.inf
        for e in sorted(events):
            if e[0] >= end:
                groups.append([])
            groups[-1].append(e)
            end = max(end, e[1]) if e[0] < end else e[1]
        out = []
        for g in groups:
            a, b = max(e[0] for e in g), min(e[1] for e in g)
            if len(g) == 1 or a < b:
                out.append((a, b, len(g)))
            else:
                size = max(e[1] - e[0] for e in g)
                k = next(i for i, e in enumerate(g) if e[1] - e[0] == size)
                out += solve(g[:k] + g[k + 1 :])
        return out

    e = _wide(spark, small).toPandas()
    for s, g in e.groupby("series"):
        want = sorted(solve(list(zip(g.stsec, g.ensec, g.pvel, g.avgvel, strict=True))))
        mine = got[got.series == s]
        have = sorted(zip(mine.stsec, mine.ensec, mine.n, strict=True))
        assert len(have) == len(want) and np.allclose(have, want, atol=1e-5)


def test_spline_resample(spark, small, frame):
    """Against a dense system of B-splines by the recursion on one spline at a time."""

    def spline(knots, i, d, x):
        if d == 0:
            last = knots[i + 1] == knots[-1] and x == knots[-1] and knots[i] < knots[i + 1]
            return 1.0 if knots[i] <= x < knots[i + 1] or last else 0.0
        a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
        return ((x - knots[i]) / a * spline(knots, i, d - 1, x) if a else 0.0) + ((knots[i + d + 1] - x) / b * spline(knots, i + 1, d - 1, x) if b else 0.0)

    got = run(spark, small, "spline_resample")
    for s, g in list(frame.dropna(subset=["x"]).groupby("series"))[:3]:
        k = g.groupby("t").x.mean()
        t, v = k.index.to_numpy(), k.to_numpy()
        mine = got[got.series == s].sort_values("i")
        if len(t) < 4:
            continue
        knots = np.concatenate(([t[0]] * 3, (t[1:-2] + t[2:-1]) / 2, [t[-1]] * 3))
        c = np.linalg.solve(np.array([[spline(knots, i, 2, x) for i in range(len(t))] for x in t]), v)
        want = [sum(c[i] * spline(knots, i, 2, x) for i in range(len(t))) for x in mine.t]
        assert np.allclose(mine.x, want, rtol=1e-4, atol=1e-4)
        assert np.allclose(np.diff(mine.t), 21600.0, atol=1e-4)


def turned(rate, seconds, hz):
    n = int(seconds * hz)
    return [("a", i / hz, i, *rate, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0) for i in range(n)]


COLUMNS = "series string, t double, pos long, gyrx double, gyry double, gyrz double, accx double, accy double, accz double, magx double, magy double, magz double"


def test_attitude_integrates_turns(spark):
    df = spark.createDataFrame(turned((0.0, 0.0, 30.0), 2.0, 100), COLUMNS)
    last = kernels.attitude(df, SERIES).orderBy(F.desc("t")).first()
    assert abs(last.yaw - 30 * 1.99) < 0.1 and abs(last.roll) < 1e-6 and abs(last.pitch) < 1e-6


def test_attitude_finds_down_and_north(spark):
    """A sensor that lies rolled by 30 degrees and turned from north, at rest: burn-in finds it at the first sample; a constant bias is learnt."""
    roll, yaw = math.radians(30), math.radians(50)
    rot = np.array([[math.cos(yaw), -math.sin(yaw), 0], [math.sin(yaw), math.cos(yaw), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, math.cos(roll), -math.sin(roll)], [0, math.sin(roll), math.cos(roll)]])
    acc, mag = rot.T @ [0, 0, 1], rot.T @ [0.5, 0, -0.8]
    rows = [("a", i / 100, i, 0.0, 0.0, 2.0, *map(float, acc), *map(float, mag)) for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS)
    first = kernels.attitude(df, SERIES, magnetometer=True, burn_in=60.0, gain=0.1).orderBy("t").first()
    assert abs(first.roll - 30) < 1 and abs(first.yaw - 50) < 1 and abs(first.pitch) < 1
    last = kernels.attitude(df, SERIES, magnetometer=True, burn_in=60.0, gain=0.1, bias_gain=0.02).orderBy(F.desc("t")).first()
    assert abs(last.roll - 30) < 1 and abs(last.yaw - 50) < 2


def test_null_model(spark, small, frame):
    """Each series' values come back in another order, one for each row, and again alike."""
    got = run(spark, small, "null_model_hash_shuffle")
    again = run(spark, small, "null_model_hash_shuffle")
    assert got.sort_values("event_id").v_other.tolist() == again.sort_values("event_id").v_other.tolist()
    for s, g in frame.groupby("series"):
        mine = got[got.series == s]
        assert sorted(mine.v_other) == sorted(g.v) and (len(g) < 5 or (mine.v_other != mine.v).any())


def test_classifier_on_a_known_trace(spark):
    """Two jumps, a stretch of pursuit and a gap: saccades where the jumps are, pursuit and fixations between, nothing in the gap; both sides of a
    gap also on their own."""
    rate, rng = 500.0, np.random.default_rng(2)
    x = np.zeros(4000)
    for at in (800, 2600):
        x[at:] += np.interp(np.arange(4000 - at), [0, 20], [0, 6.0])
    x[1200:1800] += np.linspace(0, 12, 600)
    x[1800:] += 12
    x += rng.normal(0, 0.002, 4000)
    x[3200:3400] = np.nan
    v = np.abs(np.gradient(x)) * rate
    df = spark.createDataFrame([("a", i / rate, i, None if np.isnan(a) else float(a), 0.0, None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, v, strict=True))], "series string, t double, pos long, x double, y double, vel double")
    e = kernels.classifier_events(df, SERIES, kernels.ClassifierParams(rate=rate)).toPandas()
    sacc = sorted(e[e.label == "SACC"].stsec)
    assert len(sacc) == 2 and abs(sacc[0] - 1.6) < 0.02 and abs(sacc[1] - 5.2) < 0.02
    purs = e[e.label == "PURS"]
    assert len(purs) and purs.stsec.min() > 2.2 and purs.ensec.max() < 3.8
    assert not ((e.stsec < 6.7) & (e.ensec > 6.5)).any() and set(e.label) >= {"FIXA", "SACC", "PURS"}
    split = kernels.classifier_events(df.dropna(), SERIES, kernels.ClassifierParams(rate=rate), gap=0.1).toPandas()
    assert sorted(split[split.label == "SACC"].stsec) == sacc


def test_repeated_samples_stay_rows(spark):
    s = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 50.0)], "series int, t double")
    e = spark.createDataFrame([(1, 0.0, 10.0, "a")], "series int, stsec double, ensec double, label string")
    assert sorted((r.t, r.n_events) for r in intervals.range_flags(s, e, ["series"], 7.0).collect()) == [(5.0, 1), (5.0, 1), (50.0, 0)]


def test_clusters_over_a_long_chain(spark):
    n = 100
    df = spark.createDataFrame([((i * 37) % n, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(n)], "id long, p string, q string")
    assert {r.cluster for r in graph.clusters(df, "id", ["p", "q"]).collect()} == {0}


def test_thresholds_converge():
    """More rounds than a plan would unroll; a cycle is an error in the form without a limit."""
    v = np.concatenate([1.9**k + np.arange(50) / 50 for k in range(2, 28)])
    rounds, now = 0, 1e9
    while True:
        below = v[v < now]
        new = below.mean() + 1.2 * below.std()
        rounds += 1
        if abs(new - now) <= 1:
            break
        now = new
    assert rounds > 6 and math.isclose(kinematics.threshold_of(v, 1e9, 1.2, robust=False)[0], new)
    slow = kinematics.threshold_of(v, 1e9, 0.5)
    assert slow[0] < 1e9


def test_smoothing_over_everything(spark):
    rng = np.random.default_rng(0)
    t, v = np.sort(rng.random(700) * 50), rng.random(700)
    df = spark.createDataFrame([("a", float(a), i, float(b) if i % 7 else None) for i, (a, b) in enumerate(zip(t, v, strict=True))], "series string, t double, pos long, x double")
    w = np.exp(-((t[:, None] - t) ** 2) / (2 * 0.3**2)) * (np.arange(700) % 7 > 0)
    near = np.abs(t[:, None] - t) <= 1.2
    for reach, weights in ((None, w), (4.0, w * near)):
        got = [r.smooth for r in timing.gaussian_smooth(df, "x", 0.3, reach=reach).orderBy("pos").collect()]
        assert np.allclose(got, weights @ v / weights.sum(axis=1))


def test_preprocessing(spark):
    """A noisy trace with a spike, a short dropout, a blink and a jump too fast for an eye."""
    rate, n = 500.0, 1500
    x = np.sin(np.arange(n) / 200) * 5
    x[300] += 3.0
    gone = np.zeros(n, bool)
    gone[500:503] = gone[800:850] = True
    x[1100:] += 400.0
    df = spark.createDataFrame([("a", i / rate, i, None if gone[i] else float(v), 0.0) for i, v in enumerate(x)], "series string, t double, pos long, x double, y double")
    p = traces.TraceParams(rate=rate, rescue=0.01, median=0.02)
    out = traces.preprocess(df, "x", "y", p).orderBy("pos").toPandas()
    assert abs(out.x[300] - math.sin(1.5) * 5) < 0.05
    assert out.x[498:505].notna().all() and out.x[795:855].isna().all() and out.x[790] == out.x[790]
    wild = out.index[out.x.isna()]
    assert 1100 in wild and out.blink[820] and not out.blink[501] and out.medvel[820] != out.medvel[820]
    assert np.nanmax(out.vel) < 1000 and out.vel.isna().equals(out.x.isna())
    with pytest.raises(PySparkException, match="samples are missing"):
        traces.preprocess(df.where("pos % 3 > 0"), "x", "y", p).collect()
    empty = traces.preprocess(df.withColumn("x", F.lit(None).cast("double")), "x", "y", p)
    assert empty.where("x IS NOT NULL OR vel IS NOT NULL").count() == 0


def test_smoothers_at_the_ends():
    v = np.arange(30.0) ** 2
    assert np.allclose(traces.polynomial_smooth(v, 4, 2), v)
    u = np.array([5.0, 1.0, 4.0, 2.0, 8.0])
    mirrored = [1.0, 5.0, 5.0, 1.0, 4.0, 2.0, 8.0, 8.0, 2.0]
    assert traces.median_smooth(u, 5).tolist() == [float(np.median(mirrored[i : i + 5])) for i in range(5)]


def test_gain(spark):
    """Eyes that turn against the head at half its speed."""
    t = np.arange(1000) / 100
    head = 20 * np.sin(t)
    df = spark.createDataFrame([("a", float(a), i, float(-b / 2), float(b)) for i, (a, b) in enumerate(zip(t, head, strict=True))], "series string, t double, pos long, eye double, head double")
    g = traces.velocity_gain(df, "eye", "head").toPandas()
    assert abs(g.smooth_gain.median() - 0.5) < 0.02


def test_focus(spark):
    rows = [(1, float(x), float(y), (x - 3) * 0.1, (y - 7) * 0.1) for x in range(10) for y in range(10)]
    f = traces.focus_of_expansion(spark.createDataFrame(rows, "frame int, x double, y double, u double, v double"), ["frame"]).first()
    assert math.isclose(f.foe_x, 3.0) and math.isclose(f.foe_y, 7.0)
    flat = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 5.0, 1.0, 0.0)], "frame int, x double, y double, u double, v double")
    assert traces.focus_of_expansion(flat, ["frame"]).first().foe_x is None


def test_event_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *(float(v) for v in np.exp(rng.normal(3 * k, 0.2, 3)))) for k in range(3) for _ in range(60)] + [(9, -1.0, 1.0, 1.0)]
    out, k = detect.event_clusters(spark.createDataFrame(rows, "kind int, a double, b double, c double"), ["a", "b", "c"])
    got = out.toPandas()
    assert k == 3 and len(got) == 181 and got[got.kind < 9].groupby("kind").cluster.nunique().eq(1).all() and got[got.kind < 9].cluster.nunique() == 3
    assert got[got.kind == 9].cluster.isna().all()


def test_zero_based(spark):
    df = spark.createDataFrame([("a", 5.0, 0, 0.0), ("a", 6.0, 1, 1.5)], "series string, t double, pos long, t0 double")
    assert [r.t0 for r in timing.zero_based(df.drop("t0")).orderBy("t").collect()] == [0.0, 1.0]
    with pytest.raises(PySparkException):
        timing.zero_based(df).collect()
    assert Axis(("series",)).order == ["t", "pos"] and pd.__version__


def met(frame):
    """(series1, series2): the day and both members' means of v and k, for each pair of all series and each day that both have."""
    y = frame.assign(day=np.floor(frame.t / 86400)).groupby(["series", "day"]).agg(a=("v", "mean"), b=("k", "mean")).reset_index()
    of = {s: {r.day: (r.a, r.b) for r in g.itertuples()} for s, g in y.groupby("series")}
    return {(s, o): [(d, *of[s][d], *of[o][d]) for d in sorted(of[s].keys() & of[o].keys())] for s in of for o in of if s > o}


def test_correlation_of_all_pairs(spark, small, frame):
    """Pairs of any two series, also of those whose numbers end in other digits."""
    want = {k: np.array(v) for k, v in met(frame).items() if len(v) >= 5}
    got = {(r.series1, r.series2): r for r in run(spark, small, "pairwise_corr").itertuples()}
    assert got.keys() == want.keys() and any(s % 10 != o % 10 for s, o in want)
    for k, v in want.items():
        r = got[k]
        assert r.n == len(v) and abs(r.ra - np.corrcoef(v[:, 1], v[:, 3])[0, 1]) < 6e-5 and abs(r.rb - np.corrcoef(v[:, 2], v[:, 4])[0, 1]) < 6e-5


def test_distance_of_all_pairs(spark, small, frame):
    want = {(s, o, d): math.hypot(a1 - a2, b1 - b2) for (s, o), v in met(frame).items() for d, a1, b1, a2, b2 in v}
    got = {(r.series1, r.series2, r.day): r.dist for r in run(spark, small, "pairwise_distance").itertuples()}
    assert got.keys() == want.keys() and any(s % 10 != o % 10 for s, o, _ in want)
    assert all(abs(got[k] - v) < 6e-5 for k, v in want.items())


def no_shuffle_of_pairs(df):
    top, *rest = re.split("CartesianProduct|BroadcastNestedLoopJoin", df._jdf.queryExecution().executedPlan().toString())
    return len(rest) == 1 and "Exchange" not in top


def test_correlated_pairs_stay_where_they_are_made(spark, small):
    """Only the days of series are shuffled, before they meet: the pairs of a GB would fill the disk."""
    assert no_shuffle_of_pairs(catalog.queries()["pairwise_corr"](spark, small))


@pytest.mark.parametrize("size", [4, 1024])
def test_correlations_of_odd_values(spark, monkeypatch, size):
    """Members without values, of one value, of values that hardly vary, not finite, huge; in one block and in many."""
    for name, v in (("BLOCK", size), ("BLOCK_LEAST", size), ("BLOCKS", 3), ("PAIRS", 7)):
        monkeypatch.setattr(study, name, v)
    rng = np.random.default_rng(5)
    kinds = [lambda n: rng.normal(0, 1, n), lambda n: np.full(n, 3.3), lambda n: 1e9 + rng.normal(0, 1e-3, n), lambda n: rng.integers(0, 2, n) * 1.0, lambda n: 1e-120 * rng.normal(0, 1, n), lambda n: np.where(np.arange(n) % 4 == 0, np.nan, rng.normal(0, 1, n))]
    rows = []
    for s in range(23):
        days = np.flatnonzero(rng.random(12) < (0.3 if s % 5 == 0 else 0.9))
        for d, v, w in zip(days, kinds[s % 6](len(days)), kinds[s * 7 % 5](len(days)), strict=True):
            rows.append((s, int(d), None if rng.random() < 0.2 or s == 13 else float(v), float(w)))
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0), (3, None, 1.0, 1.0)], "s long, d long, v double, w double")
    got = {(r.s1, r.s2): (r.n, r.rv, r.rw) for r in study.correlations(df, "s", "d", {"v": "rv", "w": "rw"}, 3, 4).collect()}
    of = {s: {r[1]: r[2:] for r in rows if r[0] == s} for s in range(23)}
    want = {(s, o): [(*of[s][d], *of[o][d]) for d in of[s].keys() & of[o].keys()] for s in of for o in of if s > o}
    assert got.keys() == {k for k, v in want.items() if len(v) >= 3}
    for k, (n, *r) in got.items():
        assert n == len(want[k])
        for i in (0, 1):
            x = np.array([(a[i], a[i + 2]) for a in want[k] if a[i] is not None and a[i + 2] is not None]).T
            if not x.size:
                assert r[i] is None
            elif np.isnan(x).any() or (x == x[:, :1]).all(axis=1).any():
                assert math.isnan(r[i])
            else:
                a, b = x - x[:, :1]
                a, b = (a - a.mean()) / np.abs(a).max(), (b - b.mean()) / np.abs(b).max()
                assert abs(r[i] - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 6e-5


def test_distant_pairs_stay_where_they_are_made(spark, small):
    assert no_shuffle_of_pairs(catalog.queries()["pairwise_distance"](spark, small))


@pytest.mark.parametrize("size", [4, 1024])
def test_distances_of_odd_values(spark, monkeypatch, size):
    for name, v in (("BLOCK", size), ("BLOCK_LEAST", size), ("BLOCKS", 3), ("PAIRS", 7)):
        monkeypatch.setattr(study, name, v)
    rng = np.random.default_rng(6)
    rows = [(s, d, None if s % 7 == 3 else [float(rng.normal()), math.nan, 1e9, math.inf][d % 4 if s % 2 else 0], float(rng.normal())) for s in range(23) for d in range(8) if rng.random() < 0.7]
    got = {(r.s1, r.s2, r.d): r.dist for r in study.distances(spark.createDataFrame([*rows, (None, 1, 1.0, 1.0)], "s long, d long, v double, w double"), "s", "d", ["v", "w"], "dist", 4).collect()}
    want = {(s, o, d): None if v is None or x is None else math.nan if math.isinf(v) and v == x else math.sqrt((v - x) * (v - x) + (w - y) * (w - y)) for s, d, v, w in rows for o, e, x, y in rows if d == e and s > o}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == v or math.isnan(got[k]) and math.isnan(v) or abs(got[k] - v) < 6e-5 * max(1, v / 1e9)


def test_pairs_compared_at_a_time_change_nothing(monkeypatch):
    rng = np.random.default_rng(7)
    kind = pa.struct([("s", pa.int64()), ("d", pa.int64()), ("v", pa.float64())])
    p, q = (study._Block(pa.array([{"s": s, "d": d, "v": rng.normal()} for s in range(lo, 40, 2) for d in range(9) if rng.random() < 0.8], kind)) for lo in (0, 1))
    for kernel, more in ((study._correlated, (3, 4)), (study._apart, (4,))):
        for same in (True, False):
            seen = []
            for at_a_time in (7, 200_000):
                monkeypatch.setattr(study, "PAIRS", at_a_time)
                seen.append(sorted(r for out in kernel(p, p if same else q, same, *more) for r in zip(*(x.tolist() for x in out), strict=True)))
            assert seen[0] == seen[1] and len(seen[0]) > 100 and all(r[0] > r[1] for r in seen[0])
