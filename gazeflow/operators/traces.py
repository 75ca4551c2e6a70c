"""From raw traces to speeds that a classifier can take, and what is derived from pairs of traces and flow fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeflow.operators import kinematics, runs, timing
from gazeflow.series import SERIES, Axis


def arrow_columns(df: DataFrame, axis: Axis, added: list[str], f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str]) -> DataFrame:
    """df with double columns (new or replaced) that f makes of a series' ordered inputs; all other columns pass through an Arrow task."""
    new = [c for c in added if c not in df.columns]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in axis.order])
        for name, values in f({c: rows[c].to_numpy().astype(float) for c in inputs}).items():
            column = pa.array(values, pa.float64(), from_pandas=True)
            rows = rows.append_column(name, column) if name not in rows.column_names else rows.set_column(rows.column_names.index(name), name, column)
        return rows

    fields = [T.StructField(x.name, T.DoubleType()) if x.name in added else x for x in df.schema.fields]
    return df.groupBy(*axis.keys).applyInArrow(run, T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in new)]))


def without_spikes(v: np.ndarray) -> np.ndarray:
    """Local extremes become the nearer neighbour (equally near: the next), each judged against the already filtered one before."""
    out = v.tolist()
    for i in range(1, len(out) - 1):
        a, b, c = out[i - 1 : i + 2]
        if (b > a and b > c) or (b < a and b < c):
            out[i] = a if abs(b - a) < abs(b - c) else c
    return np.array(out, float)


def filled(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Missing values by straight lines in time, at the ends the nearest value; nothing known: as it was."""
    known = np.isfinite(v)
    return np.interp(t, t[known], v[known]) if known.any() else v


def polynomial_smooth(v: np.ndarray, half: int, order: int) -> np.ndarray:
    """The least-squares polynomial over 2 half + 1 values at its middle (Savitzky and Golay, 1964); within half of an end the
    polynomial of the first or last window. Series shorter than a window: as they were."""
    n = 2 * half + 1
    if len(v) < n or half < 1:
        return v
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    hat = powers @ np.linalg.pinv(powers)
    out = np.empty(len(v))
    out[half : len(v) - half] = np.lib.stride_tricks.sliding_window_view(v, n) @ hat[half]
    out[:half], out[len(v) - half :] = hat[:half] @ v[:n], hat[half + 1 :] @ v[-n:]
    return out


def median_smooth(v: np.ndarray, size: int) -> np.ndarray:
    """The median of `size` values around each (of an even size one more before), the ends mirrored; missing where one of them is."""
    if size <= 1 or not len(v):
        return v
    padded = np.pad(v, (size // 2, size - 1 - size // 2), mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)


@dataclass(frozen=True)
class TraceParams:
    """Samples per second, and lengths in seconds; unit: seconds of one unit of the series' time."""

    rate: float
    unit: float = 1.0
    spikes: bool = True
    smooth: float = 0.019
    smooth_order: int = 2
    rescue: float = 0.0
    most_speed: float = 1000.0
    most_acceleration: float = 1e5
    widen: float = 0.010
    median: float = 0.05


def preprocess(df: DataFrame, x: str, y: str, p: TraceParams, axis: Axis = SERIES, *, blink: str | None = None) -> DataFrame:
    """df with x, y cleaned, and vel, acc, medvel: spikes out, gaps filled by lines, polynomial smoothing; then samples of blinks become
    null again, except that runs of at most rescue seconds keep what was filled in; speed and its change per second; what is at or
    over the limits becomes null with `widen` seconds around; medvel, the speed of the median-filtered trace, is null there too. x
    and y are in degrees. blink: a boolean column (default: x or y is missing), which comes back as it ends up.

    A series whose number of samples doesn't fit its duration within 0.05 % fails. A series without any x or y: all null."""
    half, k, size = int(p.smooth * p.rate) // 2, int(p.widen * p.rate), int(p.median * p.rate)
    n, span = F.count(F.lit(1)).over(axis.whole), (F.max(axis.time).over(axis.whole) - F.min(axis.time).over(axis.whole)) * p.unit
    sparse = F.abs((n - 1) / p.rate - span) > 0.0005 * span
    dense = F.when(sparse, F.raise_error(F.concat(F.lit("samples are missing in series "), F.to_json(F.struct(*axis.keys))))).otherwise(F.lit(True)).cast("boolean")
    df = df.withColumn("_bad", (F.col(blink) if blink else F.col(x).isNull() | F.col(y).isNull()))
    df = df.withColumn(x, F.col(x).cast("double")).withColumn(y, F.col(y).cast("double")).withColumn("_dense", dense).where("_dense").drop("_dense")

    def smooth(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for name in (x, y):
            v = without_spikes(c[name]) if p.spikes else c[name]
            out[name] = polynomial_smooth(filled(c[axis.time], v), half, p.smooth_order) if half else v
        return out

    df = arrow_columns(df, axis, [x, y], smooth, [axis.time, x, y])
    if p.rescue > 0:
        df = runs.long_runs(df, "_bad", int(p.rescue * p.rate) + 1, axis, "_bad2").drop("_bad").withColumnRenamed("_bad2", "_bad")
    for c in (x, y):
        df = df.withColumn(c, F.when(~F.col("_bad"), F.col(c)))
    df = df.withColumn("vel", kinematics.diff_speed(x, y, p.rate, axis))
    df = df.withColumn("acc", F.when(F.row_number().over(axis.w) == 1, F.lit(0.0)).otherwise((F.col("vel") - F.lag("vel").over(axis.w)) * p.rate))
    wild = F.coalesce((F.col("vel") >= p.most_speed) | (F.col("acc") >= p.most_acceleration), F.lit(False))
    df = df.withColumn("_wild", wild)
    df = df.select(*(F.when(~F.col("_wild"), F.col(c)).alias(c) if c in (x, y, "vel", "acc") else F.col(c) for c in df.columns)).drop("_wild")
    df = runs.null_dilated(df, [x, y, "vel", "acc"], k, axis)

    def speed(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        mx, my = median_smooth(c[x], size), median_smooth(c[y], size)
        out = np.hypot(np.diff(mx, prepend=mx[:1]), np.diff(my, prepend=my[:1])) * p.rate
        out[:1] = 0.0
        return {"medvel": out if size > 0 else c["vel"]}

    df = arrow_columns(df, axis, ["medvel"], speed, [x, y, "vel"])
    df = runs.null_dilated(df, ["medvel"], k, axis)
    return df.withColumn(blink or "blink", F.col("_bad") | F.col(x).isNull()).drop("_bad")


def velocity_gain(df: DataFrame, eye: str, head: str, axis: Axis = SERIES, *, sigma: float = 0.02, sigma_speed: float = 0.03, sigma_gain: float = 0.3, cutoff: float = 70.0, most: float = 2.0, reach: float | None = 4.0) -> DataFrame:
    """Adds eye_speed, head_speed, gain (- eye / head) and smooth_gain. Angles are smoothed with a Gaussian, differences per second at or over
    cutoff go with their rows (saccades), the eye's speed is smoothed again, gains beyond most count as missing."""
    df = timing.gaussian_smooth(df, eye, sigma, axis, reach=reach, name="_e")
    df = timing.gaussian_smooth(df, head, sigma, axis, reach=reach, name="_h")
    dt = F.col(axis.time) - F.lag(axis.time).over(axis.w)
    df = df.withColumn("_de", F.try_divide(F.col("_e") - F.lag("_e").over(axis.w), dt)).withColumn("_dt", dt).where(F.abs("_de") < cutoff)
    df = timing.gaussian_smooth(df, "_de", sigma_speed, axis, reach=reach, name="eye_speed")
    dt = F.col(axis.time) - F.lag(axis.time).over(axis.w)
    df = df.withColumn("head_speed", F.try_divide(F.col("_h") - F.lag("_h").over(axis.w), F.col("_dt"))).where(F.abs("head_speed") < cutoff)
    gain = F.try_divide(-F.col("eye_speed"), F.col("head_speed"))
    df = df.withColumn("gain", F.when(F.abs(gain) <= most, gain)).drop("_e", "_h", "_de", "_dt")
    return timing.gaussian_smooth(df, "gain", sigma_gain, axis, reach=reach, name="smooth_gain")


def flow_divergence(flow: DataFrame, frame: list[str], i: str = "i", j: str = "j", u: str = "u", v: str = "v") -> DataFrame:
    """Adds divergence to a flow field in long form (a row per frame and grid point; i, j: row and column): the gradient of u along
    rows plus that of v along columns, central inside, one-sided at the edges."""

    def gradient(value: str, along: str, across: str) -> Column:
        w = W.partitionBy(*frame, across).orderBy(along)
        a, b, c = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2).when(b.isNotNull(), b - c).otherwise(c - a)

    return flow.withColumn("divergence", gradient(u, i, j) + gradient(v, j, i))


def focus_of_expansion(flow: DataFrame, frame: list[str], x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> DataFrame:
    """frame, foe_x, foe_y: the point that the lines along all flow vectors pass nearest to, vectors weighted by their squared length; null where
    all are parallel. One aggregation of sums."""
    b = F.col(x) * F.col(v) - F.col(y) * F.col(u)
    s = flow.groupBy(*frame).agg(F.sum(F.col(v) * F.col(v)).alias("vv"), F.sum(F.col(u) * F.col(u)).alias("uu"), F.sum(F.col(u) * F.col(v)).alias("uv"), F.sum(F.col(v) * b).alias("vb"), F.sum(F.col(u) * b).alias("ub"))
    det = F.col("vv") * F.col("uu") - F.col("uv") * F.col("uv")
    det = F.when(F.abs(det) > 1e-12, det)
    return s.select(*frame, ((F.col("vb") * F.col("uu") - F.col("ub") * F.col("uv")) / det).alias("foe_x"), ((F.col("vb") * F.col("uv") - F.col("ub") * F.col("vv")) / det).alias("foe_y"))
