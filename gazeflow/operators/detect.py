"""Event detection: votes, their consensus, event geometry, blinks, and the pipeline from samples to events."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeflow.operators import intervals, kinematics, runs
from gazeflow.series import SERIES, Axis


def velocities(df: DataFrame, x: str, y: str, dt: float, half: int, axis: Axis = SERIES) -> DataFrame:
    """Adds xvel, yvel, vel by multi-lag differences."""
    df = df.withColumn("xvel", kinematics.multi_lag_velocity(x, dt, half, axis)).withColumn("yvel", kinematics.multi_lag_velocity(y, dt, half, axis))
    return df.withColumn("vel", F.sqrt(F.col("xvel") ** 2 + F.col("yvel") ** 2))


def ek_votes(df: DataFrame, factor: float, least: int, axis: Axis = SERIES, name: str = "ek") -> DataFrame:
    """True in runs of more than least samples whose velocity leaves the ellipse of factor times the median-based sigmas. A sigma that is
    missing or 0 gives no votes. Needs xvel, yvel."""
    keys = ", ".join(axis.keys)
    for c in ("xvel", "yvel"):
        m2, m1 = F.expr(f"percentile({c} * {c}, 0.5) OVER (PARTITION BY {keys})"), F.expr(f"percentile({c}, 0.5) OVER (PARTITION BY {keys})")
        df = df.withColumn(f"_m2{c}", m2).withColumn(f"_m1{c}", m1).withColumn(f"_s{c}", F.when(F.col(f"_m2{c}") > F.col(f"_m1{c}") ** 2, F.sqrt(F.col(f"_m2{c}") - F.col(f"_m1{c}") ** 2)))
    out = F.try_divide(F.col("xvel"), factor * F.col("_sxvel")) ** 2 + F.try_divide(F.col("yvel"), factor * F.col("_syvel")) ** 2 > 1
    df = df.withColumn("_out", F.coalesce(out, F.lit(False)))
    df = runs.long_runs(df, "_out", least + 1, axis, name)
    return df.drop("_out", *(f"_{m}{c}" for m in ("m2", "m1", "s") for c in ("xvel", "yvel")))


def nh_votes(df: DataFrame, start: float, c: float, axis: Axis = SERIES, name: str = "nh") -> DataFrame:
    """True in runs above the onset threshold that reach the peak threshold; both from kinematics.threshold_of() by mean and sigma. Needs vel."""
    df = kinematics.with_threshold(df, "vel", start, c, axis, robust=False)
    return runs.hysteresis(df, F.col("vel") > F.col("threshold"), F.col("vel") > F.col("onset"), axis, name).drop("threshold", "onset")


def peaks_taken(t: np.ndarray, v: np.ndarray, threshold: float, apart: float, most: int) -> np.ndarray:
    """True around the fastest local peaks above a threshold, taken greedily by speed, at least `apart` in time from those taken and with at most
    `most` of those within half a second, and grown while the speed stays above the threshold. Missing speeds are below it."""
    filled = np.where(np.isfinite(v), v, -np.inf)
    inner = np.zeros(len(v), bool)
    if len(v) > 2:
        inner[1:-1] = (filled[1:-1] >= filled[:-2]) & (filled[1:-1] >= filled[2:])
    taken: list[float] = []  # times in order
    out, above = np.zeros(len(v), bool), filled > threshold
    edge = np.flatnonzero(np.diff(above.astype(np.int8), prepend=0, append=0))
    for i in sorted(np.flatnonzero(inner & above).tolist(), key=lambda i: (-filled[i], i)):
        at = bisect_left(taken, t[i])
        if any(abs(x - t[i]) < apart for x in taken[max(0, at - 1) : at + 1]):
            continue
        if bisect_right(taken, t[i] + 0.5) - bisect_left(taken, t[i] - 0.5) >= most:
            continue
        taken.insert(at, float(t[i]))
        run = int(np.searchsorted(edge, i, "right")) - 1
        out[edge[run] : edge[run + 1]] = True
    return out


def om_votes(df: DataFrame, threshold: float, apart: float, most: int, axis: Axis = SERIES, name: str = "om") -> DataFrame:
    """Adds peaks_taken(). What is taken depends on what was, so a series is one Arrow task; rows pass through. Needs vel."""

    def vote(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in axis.order])
        flags = peaks_taken(rows[axis.time].to_numpy().astype(float), rows["vel"].to_numpy().astype(float), threshold, apart, most)
        return rows.append_column(name, pa.array(flags))

    return df.groupBy(*axis.keys).applyInArrow(vote, T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))


def consensus(df: DataFrame, votes: list[str], gap: int, least: int, axis: Axis = SERIES, name: str = "sacc") -> DataFrame:
    """True where the mean of votes is over 0.99 (n - 1) / n (one: any vote), after filling gaps and dropping short runs."""
    share = sum((F.col(v).cast("double") for v in votes), F.lit(0.0)) / len(votes)
    df = df.withColumn("_c", share > max(0.99 * (len(votes) - 1) / len(votes), 1e-9))
    df = runs.gap_filled(df, "_c", gap, axis, "_f").drop("_c")
    return runs.long_runs(df, "_f", least, axis, name).drop("_f")


def events_of(df: DataFrame, flag: str, x: str, y: str, label: Column, axis: Axis = SERIES, *, vel: str = "vel", dva_per_px: float = 1.0) -> DataFrame:
    """One row per run of flag with more than one sample: label, times, end points, displacement, amplitude, angle in degrees, and peak,
    median and mean speed. Times: from the first sample to the next run's first."""
    df = runs.with_runs(df, flag, axis)
    df = df.withColumn("_next", F.coalesce(F.lead(axis.time).over(axis.w), F.col(axis.time)))
    order = F.struct(*axis.order)
    g = df.groupBy(*axis.keys, "run").agg(
        F.first(flag).alias("_flag"), F.first(label).alias("label"), F.min(axis.time).alias("stsec"), F.max("_next").alias("ensec"), F.count(F.lit(1)).alias("n"),
        F.min_by(x, order).alias("stx"), F.min_by(y, order).alias("sty"), F.max_by(x, order).alias("enx"), F.max_by(y, order).alias("eny"),
        F.max(vel).alias("pvel"), F.expr(f"percentile({vel}, 0.5)").alias("medvel"), F.avg(vel).alias("avgvel"),
    ).where("_flag AND n > 1")
    dx, dy = (F.col("enx") - F.col("stx")) * dva_per_px, (F.col("eny") - F.col("sty")) * dva_per_px
    g = g.withColumn("dursec", F.col("ensec") - F.col("stsec")).withColumn("dxdva", dx).withColumn("dydva", dy)
    g = g.withColumn("ampldva", F.sqrt(F.col("dxdva") ** 2 + F.col("dydva") ** 2)).withColumn("angle", F.degrees(F.atan2("dydva", "dxdva")))
    return g.drop("_flag", "run", "n")


def blink_events(df: DataFrame, bad: str, x: str, y: str, axis: Axis = SERIES) -> DataFrame:
    """One row per run of bad samples, from the good sample before it to the second after it (or the series' ends): label BLNK, times, end
    points, amplitude and angle."""
    row = lambda k: F.lag(F.struct(F.col(axis.time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")), k).over(axis.w)
    own = F.struct(F.col(axis.time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    df = runs.with_runs(df, bad, axis).withColumn("_own", own).withColumn("_before", F.coalesce(row(1), own))
    df = df.withColumn("_after", F.coalesce(row(-2), row(-1), own))
    order = F.struct(*axis.order)
    g = df.where(F.col(bad)).groupBy(*axis.keys, "run").agg(F.min_by("_before", order).alias("a"), F.max_by("_after", order).alias("b"))
    g = g.select(*axis.keys, F.lit("BLNK").alias("label"), F.col("a.t").alias("stsec"), F.col("b.t").alias("ensec"), F.col("a.x").alias("stx"), F.col("a.y").alias("sty"), F.col("b.x").alias("enx"), F.col("b.y").alias("eny"))
    dx, dy = F.col("enx") - F.col("stx"), F.col("eny") - F.col("sty")
    return g.withColumn("dursec", F.col("ensec") - F.col("stsec")).withColumn("ampldva", F.sqrt(dx * dx + dy * dy)).withColumn("angle", F.degrees(F.atan2(dy, dx)))


def bad_labels(df: DataFrame, value: str, width: float, c_median: float, c_mad: float, k: int, orphan: float, bracket: float, axis: Axis = SERIES) -> DataFrame:
    """Adds bad: value missing, or its rate of change over c_median medians and c_mad MADs of the series, widened by k samples, with short good
    runs taken in (without_orphans). value is smoothed over width seconds first."""
    from gazeflow.operators.timing import range_frame

    keys = ", ".join(axis.keys)
    df = df.withColumn("_s", F.when(F.col(value).isNotNull(), range_frame(f"avg({value})", width / 2, width / 2, axis)))
    df = df.withColumn("_r", kinematics.rate_of_change("_s", axis))
    df = df.withColumn("_m", F.expr(f"percentile(_r, 0.5) OVER (PARTITION BY {keys})")).withColumn("_d", F.expr(f"percentile(abs(_r - _m), 0.5) OVER (PARTITION BY {keys})"))
    pre = F.col(value).isNull() | F.coalesce(F.col("_r") > c_median * F.col("_m") + c_mad * F.col("_d"), F.lit(False))
    df = runs.dilated(df, pre, k, axis, name="_pre").drop("_s", "_r", "_m", "_d")
    return runs.orphans_taken_in(df, "_pre", orphan, bracket, axis, name="bad").drop("_pre")


def event_clusters(events: DataFrame, features: list[str], ks: tuple[int, ...] = (2, 3, 4), *, components: int = 2, seed: int = 7) -> tuple[DataFrame, int]:
    """events with pc (principal components of the standardised logarithms of positive features) and cluster (from 0, by k-means), and the number
    of clusters of the best silhouette. Events that lack a feature, or hold one that isn't positive, have neither. Sums and distances run on
    the executors; only centres come to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    fine = F.lit(True)
    for c in features:
        fine = fine & F.coalesce(F.col(c) > 0, F.lit(False))
    df = events.select("*", *(F.log(c).alias(f"_log_{c}") for c in features)).withColumn("_fine", fine)
    good = VectorAssembler(inputCols=[f"_log_{c}" for c in features], outputCol="_raw").transform(df.where("_fine"))
    good = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(good).transform(good)
    good = PCA(k=min(components, len(features)), inputCol="_z", outputCol="pc").fit(good).transform(good)
    best = None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="pc", predictionCol="cluster").fit(good)
        quality = ClusteringEvaluator(featuresCol="pc", predictionCol="cluster").evaluate(model.transform(good))
        if best is None or quality > best[0]:
            best = quality, k, model
    drop = ["_raw", "_z", "_fine", *(f"_log_{c}" for c in features)]
    out = best[2].transform(good).drop(*drop)
    return out.unionByName(df.where("NOT _fine").drop(*drop), allowMissingColumns=True), best[1]


@dataclass(frozen=True)
class EventParams:
    """Times in the unit of the series."""

    dt: float
    half: int = 2
    ek_factor: float = 1.0
    ek_least: int = 1
    nh_start: float = 1e-3
    nh_factor: float = 3.0
    om_threshold: float = 5e-4
    om_apart: float = 0.03
    om_most: int = 5
    gap: int = 1
    least: int = 2
    min_amplitude: float = 0.33
    margin: float = 0.0


def saccades_and_blinks(df: DataFrame, flag: str, bad: str, x: str, y: str, axis: Axis = SERIES, *, vel: str = "vel") -> DataFrame:
    """The events of events_of(flag, label SACC) and blink_events(bad) in one aggregation: label, times, end points, ampldva, pvel, avgvel. A sample
    counts once for each kind that it belongs to."""
    df = runs.with_runs(runs.with_runs(df, flag, axis, name="_rs"), bad, axis, name="_rb")
    at = lambda k: F.struct(F.col(axis.time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")) if k == 0 else F.lag(F.struct(F.col(axis.time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")), k).over(axis.w)
    df = df.withColumn("_own", at(0)).withColumn("_p1", at(1)).withColumn("_n1", at(-1)).withColumn("_n2", at(-2))
    own = F.col("_own")
    until = F.struct(F.coalesce(F.col("_n1.t"), own.t).alias("t"), own.x.alias("x"), own.y.alias("y"))
    part = lambda label, run, a, b, v: F.struct(F.lit(label).alias("label"), F.col(run).alias("run"), a.alias("a"), b.alias("b"), v.alias("v"))
    sacc = F.when(F.coalesce(F.col(flag), F.lit(False)), part("SACC", "_rs", own, until, F.col(vel)))
    blink = F.when(F.coalesce(F.col(bad), F.lit(False)), part("BLNK", "_rb", F.coalesce("_p1", own), F.coalesce("_n2", "_n1", own), F.lit(None).cast("double")))
    rows = df.select(*axis.keys, F.struct(*axis.order).alias("_o"), F.explode(F.filter(F.array(sacc, blink), lambda e: e.isNotNull())).alias("_e"))
    g = rows.groupBy(*axis.keys, F.col("_e.label").alias("label"), F.col("_e.run").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min_by("_e.a", "_o").alias("a"), F.max_by("_e.b", "_o").alias("b"), F.max("_e.v").alias("pvel"), F.avg("_e.v").alias("avgvel"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return g.where("label = 'BLNK' OR n > 1").select(*axis.keys, "label", F.col("a.t").alias("stsec"), F.col("b.t").alias("ensec"), F.col("a.x").alias("stx"), F.col("a.y").alias("sty"), F.col("b.x").alias("enx"), F.col("b.y").alias("eny"), F.sqrt(dx * dx + dy * dy).alias("ampldva"), "pvel", "avgvel")


def samples_to_events(df: DataFrame, x: str, y: str, p: EventParams, axis: Axis = SERIES, *, velocity: Callable[..., DataFrame] = velocities, more_votes: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Votes of three detectors and of more_votes (each adds a boolean column of its name; velocity adds xvel, yvel, vel), their consensus (two of
    three), saccade-like events over a least amplitude, blinks, envelopes around blinks, and the gaps between: label, stsec,
    ensec, dursec. The samples are read once and shuffled once, by the series' keys."""
    df = velocity(df, x, y, p.dt, p.half, axis)
    df = ek_votes(df, p.ek_factor, p.ek_least, axis)
    df = nh_votes(df, p.nh_start, p.nh_factor, axis)
    df = om_votes(df, p.om_threshold, p.om_apart, p.om_most, axis)
    for vote in (more_votes or {}).values():
        df = vote(df)
    df = consensus(df, ["ek", "nh", "om", *(more_votes or {})], p.gap, p.least, axis)
    both = saccades_and_blinks(df.withColumn("_bad", F.col(x).isNull()), "sacc", "_bad", x, y, axis).where((F.col("label") == "BLNK") | (F.col("ampldva") > p.min_amplitude))
    both = both.select(*axis.keys, "label", "stsec", "ensec", "pvel", "avgvel")
    merged = intervals.merge_envelope(both, list(axis.keys), p.margin, F.col("label") == "BLNK")
    # As intervals.complement(), but in one pass: each event brings the gap before it along.
    w = W.partitionBy(*axis.keys).orderBy("stsec", "ensec")
    before = F.coalesce(F.lag("ensec").over(w), F.lit(0.0))
    merged = merged.withColumn("_before", before).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*axis.keys)))
    row = lambda label, st, en: F.struct(label.alias("label"), st.alias("stsec"), en.alias("ensec"), (en - st).alias("dursec"))
    own, gap = row(F.col("label"), F.col("stsec"), F.col("ensec")), row(F.lit("ISI"), F.col("_before"), F.col("stsec"))
    return merged.select(*axis.keys, F.explode(F.when(F.col("_n") > 1, F.array(own, gap)).otherwise(F.array(own))).alias("_e")).select(*axis.keys, "_e.*")


def between_peaks(df: DataFrame, acc: str, high: float, low: float, longest: float, axis: Axis = SERIES) -> DataFrame:
    """Intervals from acc > high to acc < low that last less than longest."""
    df = runs.two_state(df, F.col(acc) > high, F.col(acc) < low, axis)
    r = runs.run_table(df, "state", axis)
    return r.where((F.col("v") == 1) & (F.col("lent") < longest)).select(*axis.keys, F.col("st").alias("stsec"), F.col("et").alias("ensec"), F.col("lent").alias("dursec"))


def events_by_label_runs(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    """Runs of lab as events: label, stsec, ensec, dursec, pvel (largest v), avgvel (mean v)."""
    df = runs.with_runs(df, "lab", axis)
    own = W.partitionBy(*axis.keys).orderBy("run")
    g = df.groupBy(*axis.keys, "run").agg(F.first("lab").alias("label"), F.min(axis.time).alias("stsec"), F.max(axis.time).alias("last"), F.max("v").alias("pvel"), F.avg("v").alias("avgvel"))
    g = g.withColumn("ensec", F.coalesce(F.lead("stsec").over(own), F.col("last")))
    return g.withColumn("dursec", F.col("ensec") - F.col("stsec")).select(*axis.keys, "label", "stsec", "ensec", "dursec", "pvel", "avgvel")
