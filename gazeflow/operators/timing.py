"""Resampling, interpolation, smoothing and as-of joins on series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeflow.series import SERIES, Axis

MAX_POINTS = 1_000_000_000


def grid(series: DataFrame, step: float, axis: Axis = SERIES, *, past_end: bool = True) -> DataFrame:
    """One row per series and point: keys, i, t = start + i * step, from each series' first time to its last (past it, if the span isn't
    whole steps). A series with more than MAX_POINTS points fails."""
    ends = series.groupBy(*axis.keys).agg(F.min(axis.time).alias("_a"), F.max(axis.time).alias("_b"))
    whole = (F.col("_b") - F.col("_a")) / F.lit(step)
    n = (F.ceil(whole) if past_end else F.floor(whole)).cast("long")
    n = F.when(n > MAX_POINTS, F.raise_error(F.lit("more grid points than MAX_POINTS"))).otherwise(n)
    return ends.select(*axis.keys, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"), "_a").withColumn(axis.time, F.col("_a") + F.col("i") * F.lit(step)).drop("_a")


def _union(samples: DataFrame, points: DataFrame, columns: list[str], axis: Axis) -> tuple[DataFrame, Axis]:
    """Samples (side 0) and points (side 1) as one sequence."""
    s = samples.select(*axis.keys, axis.time, *columns, F.lit(None).cast("long").alias("i"), F.lit(0).alias("_side"), *(F.col(c).cast("long").alias(f"_o{k}") for k, c in enumerate(axis.tiebreak)))
    p = points.select(*axis.keys, axis.time, *(F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in columns), "i", F.lit(1).alias("_side"), *(F.lit(0).cast("long").alias(f"_o{k}") for k in range(len(axis.tiebreak))))
    return s.unionByName(p), Axis(axis.keys, axis.time, ("_side", *(f"_o{k}" for k in range(len(axis.tiebreak)))))


def resample(samples: DataFrame, points: DataFrame, linear: list[str], fill: list[str] = (), axis: Axis = SERIES, *, max_gap: float | dict[str, float] | None = None) -> DataFrame:
    """The points with columns interpolated linearly in time between the nearest samples that have them (at the ends: the nearest one's
    value), and columns filled forward. With max_gap (one, or one for each column), a value is kept only within that distance of a sample that has it."""
    both, ax = _union(samples, points, [*linear, *fill], axis)
    before, after, t = ax.rows(None, 0), ax.rows(0, None), F.col(axis.time)
    out: dict[str, Column] = {}
    for c in linear:
        known = F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v")))
        a, b = F.last(known, True).over(before), F.first(known, True).over(after)
        both = both.withColumn(f"_a_{c}", a).withColumn(f"_b_{c}", b)
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        between = F.when(a.t == b.t, a.v).otherwise(a.v + F.try_divide((b.v - a.v) * (t - a.t), b.t - a.t))
        value = F.coalesce(between, a.v, b.v)
        gap = max_gap.get(c) if isinstance(max_gap, dict) else max_gap
        if gap is not None:
            value = F.when(F.least(t - a.t, b.t - t) <= gap, value)
        out[c] = value
    for c in fill:
        both = both.withColumn(f"_f_{c}", F.last(c, True).over(before))
        out[c] = F.col(f"_f_{c}")
    return both.where("_side = 1").select(*axis.keys, "i", axis.time, *(v.alias(c) for c, v in out.items()))


def asof(left: DataFrame, right: DataFrame, columns: list[str], axis: Axis, *, direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """left with columns of the right row at or before (backward), strictly after (forward), or nearest in time (nearest; ties go
    back); null where there is none, or none within the tolerance. Union and window: one shuffle by the keys, no range join."""
    cols = [*columns, axis.time]
    names = left.columns
    r = right.select(*axis.keys, F.col(axis.time), F.struct(*cols).alias("_r"), F.lit(0).alias("_side"))
    row = F.struct(*(F.col(c) for c in names)).alias("_l")
    both = left.select(*axis.keys, F.col(axis.time), row, F.lit(1).alias("_side")).unionByName(r, allowMissingColumns=True)
    ax = Axis(axis.keys, axis.time, ("_side",))
    back, ahead = F.last("_r", True).over(ax.rows(None, 0)), F.first("_r", True).over(ax.rows(0, None))
    both = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_side = 1")
    t, a, b = F.col(axis.time), F.col(f"_back.{axis.time}"), F.col(f"_ahead.{axis.time}")
    hit = {"backward": F.col("_back"), "forward": F.col("_ahead"), "nearest": F.when(b.isNull() | (t - a <= b - t), F.col("_back")).otherwise(F.col("_ahead"))}[direction]
    both = both.withColumn("_hit", hit)
    if tolerance is not None:
        both = both.withColumn("_hit", F.when(F.abs(F.col(f"_hit.{axis.time}") - t) <= tolerance, F.col("_hit")))
    return both.select("_l.*", *(F.col(f"_hit.{c}").alias(c) for c in columns), F.col(f"_hit.{axis.time}").alias(f"{axis.time}_r"))


def zero_based(df: DataFrame, axis: Axis = SERIES, *, zero: str | None = None, name: str = "t0") -> DataFrame:
    """Adds the time since the series' first sample, or since column zero. Where df has name already, it must agree (1e-9), or the query fails."""
    own = F.col(axis.time) - (F.col(zero) if zero else F.min(axis.time).over(axis.whole))
    if name in df.columns:
        own = F.when(F.abs(F.col(name) - own) > 1e-9, F.raise_error(F.lit(f"{name} isn't zero-based"))).otherwise(F.col(name))
    return df.withColumn(name, own)


def look_back(left: DataFrame, right: DataFrame, columns: list[str], axis: Axis, width: float) -> DataFrame:
    """left with columns of the right row of the same time, or else the latest within width before; null where there is none."""
    return asof(left, right, columns, axis, tolerance=width)


def bin_mean(df: DataFrame, width: float, columns: list[str], axis: Axis = SERIES) -> DataFrame:
    """keys, bin, n and the means of columns in bins of the series' own time."""
    first = F.min(axis.time).over(axis.whole)
    b = F.floor((F.col(axis.time) - first) / F.lit(width)).cast("long")
    return df.withColumn("bin", b).groupBy(*axis.keys, "bin").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns))


def range_frame(expr: str, before: float, after: float, axis: Axis = SERIES) -> Column:
    """An aggregate over the rows from before seconds before to after seconds after, both included."""
    keys = ", ".join(axis.keys)
    return F.expr(f"{expr} OVER (PARTITION BY {keys} ORDER BY {axis.time} RANGE BETWEEN {before}D PRECEDING AND {after}D FOLLOWING)")


def gaussian_smooth(df: DataFrame, value: str, sigma: float, axis: Axis = SERIES, *, reach: float | None = 4.0, name: str = "smooth") -> DataFrame:
    """Adds the mean of value weighted by exp(-dt^2 / 2 sigma^2) over the series' samples within reach sigmas, or over all (None).

    A weight left out is at most w = exp(-reach^2 / 2) of the largest (4: 3.4e-4). Against the form over all samples the result moves by at
    most R * m * w / s, with R the series' range of values, m its samples beyond the reach and s the sum of the weights within.
    Sums run over blocks of rows against the stretch of the sorted series that they reach, in an Arrow task for each series, so
    memory is a block's, not that of all pairs."""

    def smooth(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in axis.order])
        t, v = rows[axis.time].to_numpy().astype(float), rows[value].to_numpy().astype(float)
        known = np.isfinite(v)
        kt, kv = t[known], v[known]
        out = np.full(len(t), np.nan)
        far = np.inf if reach is None else reach * sigma
        for a in range(0, len(t), 512):
            at = t[a : a + 512, None]
            i, j = np.searchsorted(kt, at[0, 0] - far), np.searchsorted(kt, at[-1, 0] + far, "right")
            dt = kt[None, i:j] - at
            w = np.where(np.abs(dt) <= far, np.exp(-dt * dt / (2 * sigma * sigma)), 0.0)
            total = w.sum(axis=1)
            out[a : a + 512] = np.divide(w @ kv[i:j], total, out=np.full(len(at), np.nan), where=total > 0)
        return rows.append_column(name, pa.array(out, pa.float64(), from_pandas=True))

    return df.groupBy(*axis.keys).applyInArrow(smooth, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def sample_rate(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    """Per series: n, median_dt, min_dt, regular (every step within 1e-6 + 0.1 % of the median), rate (1 / median_dt, two places)."""
    d = df.withColumn("_dt", F.col(axis.time) - F.lag(axis.time).over(axis.w))
    d = d.withColumn("_m", F.expr(f"percentile(_dt, 0.5) OVER (PARTITION BY {', '.join(axis.keys)})"))
    fine = F.coalesce(F.abs(F.col("_dt") - F.col("_m")) <= 1e-6 + 1e-3 * F.abs("_m"), F.lit(True))
    return d.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("n"), F.first("_m").alias("median_dt"), F.min("_dt").alias("min_dt"), F.min(fine).alias("regular")).withColumn("rate", F.when(F.col("median_dt") > 0, F.round(1 / F.col("median_dt"), 2)))
