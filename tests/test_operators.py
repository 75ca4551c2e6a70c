"""Operators on hand-computed series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeflow.functions import scalar
from gazeflow.operators import cleaning, detect, graph, intervals, kernels, kinematics, runs, timing
from gazeflow.series import SERIES, Axis, ensure_columns


def series(spark, values, kind="double"):
    return spark.createDataFrame([("a", float(i), i, v) for i, v in enumerate(values)], f"series string, t double, pos long, x {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


def test_runs_merge_and_split_nulls(spark):
    df = series(spark, [1.0, 1.0, 2.0, None, None, 2.0])
    merged = runs.run_table(df, "x").orderBy("run").collect()
    assert [(r.v, r.sidx, r.lidx, r.st, r.et) for r in merged] == [(1.0, 0, 2, 0.0, 2.0), (2.0, 2, 1, 2.0, 3.0), (None, 3, 2, 3.0, 5.0), (2.0, 5, 1, 5.0, 5.0)]
    assert runs.run_table(df, "x", split_nulls=True).count() == 5
    back = runs.inverse_runs(runs.run_table(df, "x")).orderBy("pos").collect()
    assert [r.v for r in back] == [1.0, 1.0, 2.0, None, None, 2.0]


def test_dilation(spark):
    df = series(spark, [0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0])
    assert column(runs.dilated(df, F.col("x").isNull(), 1), "dilated") == [False, False, True, True, True, False, False]
    assert not any(column(runs.dilated(df, F.col("x").isNull(), 1, max_ignore=1), "dilated"))


def test_spike_filter_is_sequential(spark):
    assert column(kernels.spike_filter(series(spark, [0.0, 5.0, 0.0, 5.0, 0.0]), SERIES, "x", "f"), "f") == [0.0, 0.0, 0.0, 0.0, 0.0]


def test_orphans(spark):
    r = spark.createDataFrame([("a", 1, False, 5.0), ("a", 2, True, 50.0), ("a", 3, False, 5.0), ("a", 4, True, 50.0), ("a", 5, False, 60.0)], "series string, run long, v boolean, lent double")
    got = runs.without_orphans(r, SERIES, 10.0, 40.0).orderBy("run").collect()
    assert [x.bad for x in got] == [True, True, True, True, False]


def test_intervals(spark):
    e = spark.createDataFrame([("a", "SACC", 0.0, 2.0, 1.0, 1.0), ("a", "SACC", 2.0, 3.0, 3.0, 2.0), ("a", "BLNK", 5.0, 6.0, 2.0, 2.0)], "series string, label string, stsec double, ensec double, pvel double, avgvel double")
    touch = intervals.merge_envelope(e, ["series"], 0.5, F.col("label") == "BLNK").orderBy("stsec").collect()
    assert [(r.stsec, r.ensec, r.label, r.n) for r in touch] == [(0.0, 3.0, "BLNK", 2), (5.0, 6.0, "BLNK", 1)]
    assert intervals.intersect_groups(e, ["series"]).count() == 3  # touching events part
    gaps = intervals.complement(e.withColumn("dursec", F.lit(0.0)), ["series"]).orderBy("stsec").collect()
    assert [(r.stsec, r.ensec) for r in gaps] == [(0.0, 0.0), (2.0, 2.0), (3.0, 5.0)]
    deep = spark.createDataFrame([("a", 0.0, 10.0, 1.0, 1.0), ("a", 1.0, 2.0, 2.0, 1.0), ("a", 5.0, 6.0, 3.0, 1.0)], "series string, stsec double, ensec double, pvel double, avgvel double")
    assert sorted((r.stsec, r.ensec) for r in intervals.intersect_recursive(deep, ["series"]).collect()) == [(1.0, 2.0), (5.0, 6.0)]


@pytest.mark.parametrize("marks,pairs", [("SSE", [(0, 2)]), ("SAS E".replace(" ", ""), [(2, 3)]), ("SES", [(0, 1)]), ("ESE", [(1, 2)])])
def test_pairing(spark, marks, pairs):
    m = spark.createDataFrame([("a", float(i), i, c) for i, c in enumerate(marks)], "series string, t double, pos long, mark string")
    assert sorted((r.stsec, r.ensec) for r in intervals.pair_markers(m, ["series"]).collect()) == [(float(a), float(b)) for a, b in pairs]


def test_asof(spark):
    left = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 9.0), ("b", 1.0)], "series string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20)], "series string, t double, v int")
    ax = Axis(("series",), "t", ())
    get = lambda **k: [r.v for r in timing.asof(left, right, ["v"], ax, **k).orderBy("series", "t").collect()]
    assert get() == [None, 10, 20, None]
    assert get(direction="forward") == [10, 20, None, None]
    assert get(direction="nearest", tolerance=1.0) == [10, 10, None, None]


def test_resample_gap_limit_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 0.0), ("a", 4.0, 1, 8.0)], "series string, t double, pos long, x double")
    out = timing.resample(df, timing.grid(df, 1.0), ["x"], max_gap=1.0).orderBy("i").collect()
    assert [r.x for r in out] == [0.0, 2.0, None, 6.0, 8.0]


def test_rotation_axes(spark):
    v = spark.createDataFrame([(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], "x double, y double, z double")
    yaw, pitch, roll = scalar.yaw_pitch_roll(F.col("x"), F.col("y"), F.col("z"))
    assert [tuple(round(c, 6) + 0.0 for c in r) for r in v.select(yaw, pitch, roll).collect()] == [(0, 0, 0), (0, 180, 0), (90, 0, 0), (0, -90, 0)]


def test_smoothing_keeps_parabolas(spark):
    df = series(spark, [float(i * i) for i in range(9)])
    assert np.allclose([v for v in column(df.withColumn("s", kinematics.polynomial_smooth("x", 2)), "s") if v is not None], [i * i for i in range(2, 7)])


def test_eye_columns():
    assert cleaning.eye_columns(["gx_left", "gx_right", "t"], ["_(left|right)"]) == {"gx_left": ("left", "gx"), "gx_right": ("right", "gx")}
    with pytest.raises(ValueError):
        cleaning.eye_columns(["gx_left"], ["_(left)", "(left)"])


def test_clusters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "c", None), (5, None, None)], "id long, p string, q string")
    assert {r.id: r.cluster for r in graph.clusters(df, "id", ["p", "q"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_blinks_at_both_ends(spark):
    df = series(spark, [None, 1.0, 2.0, None, 3.0, None]).withColumn("y", F.col("x")).withColumn("bad", F.col("x").isNull())
    assert sorted((r.stsec, r.ensec) for r in detect.blink_events(df, "bad", "x", "y").collect()) == [(0.0, 2.0), (2.0, 5.0), (4.0, 5.0)]


def test_synthetic_saccades_are_found(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(4000)
    at = list(range(300, 3900, 400))
    for k, i in enumerate(at):
        x[i:] += np.interp(np.arange(4000 - i), [0, 30], [0, 5 * (-1) ** k])
    x += rng.normal(0, 0.003, 4000)
    df = spark.createDataFrame([("a", i / 1000, i, float(v), 0.0) for i, v in enumerate(x)], "series string, t double, pos long, x double, y double")
    p = detect.EventParams(dt=0.001, half=6, ek_factor=6.0, ek_least=8, nh_start=100.0, nh_factor=5.0, om_threshold=30.0, gap=10, least=8)
    found = [r.stsec for r in detect.samples_to_events(df, "x", "y", p).where("label = 'SACC'").collect()]
    assert len(found) == len(at) and all(min(abs(f - a / 1000) for f in found) < 0.02 for a in at)


def test_ensure_columns(spark):
    out = ensure_columns(spark.createDataFrame([(1.0,)], "t double"), "t double, eye string, x double")
    assert out.dtypes == [("t", "double"), ("eye", "string"), ("x", "double")] and out.first() == (1.0, "", None)


def test_online_runs(spark, tmp_path):
    from gazeflow.streaming import windows

    rows = [("a", f"2024-01-01 00:00:0{i}", v) for i, v in enumerate([1.0, 5.0, 6.0, 1.0, 7.0, 0.0])]
    spark.createDataFrame(rows, "k string, ts string, v double").select("k", F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = windows.online_runs(src, "k", "ts", "v", 4.0).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    base = 1704067200.0
    assert sorted((r.stsec - base, r.ensec - base, r.n, r.peak) for r in spark.table("online").collect()) == [(1.0, 2.0, 2, 6.0), (4.0, 4.0, 1, 7.0)]


def test_expectations(spark):
    from pyspark.errors import PySparkException

    from gazeflow import expectations

    good = series(spark, [1.0, 2.0, 3.0])
    assert expectations.regular(expectations.times_unique(good)).count() == 3
    uneven = spark.createDataFrame([("a", 0.0, 0), ("a", 1.0, 1), ("a", 5.0, 2), ("a", 6.0, 3)], "series string, t double, pos long")
    double = spark.createDataFrame([("a", 0.0, 0), ("a", 0.0, 1)], "series string, t double, pos long")
    for check, df in ((expectations.regular, uneven), (expectations.times_unique, double), (expectations.times_known, spark.createDataFrame([("a", None, 0)], "series string, t double, pos long"))):
        with pytest.raises(PySparkException):
            check(df).collect()
    eyes = spark.createDataFrame([("a", "L", 0.0), ("a", "R", 0.0), ("a", "L", 1.0)], "series string, eye string, t double")
    with pytest.raises(PySparkException):
        expectations.eyes_alike(eyes, ["series"], "t").collect()
    assert (kinematics.samples_of(0.0125, 1000), kinematics.odd_samples(0.024, 1000), kinematics.odd_samples(0.001, 500)) == (12, 25, 3)


def test_a_voter_and_a_velocity_of_ones_own(spark):
    df = series(spark, [0.0] * 20 + [10.0] * 20).withColumn("y", F.lit(0.0))
    own = lambda d: d.withColumn("own", F.col("t").between(19.0, 22.0))
    p = detect.EventParams(dt=1.0, half=1, nh_start=3.0, nh_factor=1.0, om_threshold=3.0, om_apart=1.0, gap=1, least=1)
    assert detect.samples_to_events(df, "x", "y", p, velocity=detect.velocities, more_votes={"own": own}).where("label = 'SACC'").count() >= 0
