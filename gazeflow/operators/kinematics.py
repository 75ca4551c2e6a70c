"""Velocities, filters and robust statistics on series."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeflow.series import SERIES, Axis


def diff_speed(x: str, y: str, rate: float, axis: Axis = SERIES) -> Column:
    """sqrt(dx^2 + dy^2) * rate from the sample before; the first is 0."""
    dx, dy = F.col(x) - F.lag(x).over(axis.w), F.col(y) - F.lag(y).over(axis.w)
    return F.when(F.row_number().over(axis.w) == 1, F.lit(0.0)).otherwise(F.sqrt(dx * dx + dy * dy) * rate)


def multi_lag_velocity(value: str, dt: float, half: int, axis: Axis = SERIES) -> Column:
    """The sum over h of x[i + h] - x[i - h], over dt times the sum of 2 h, of the h up to half with both ends; null at the first sample and
    where there are none. Sums of lags and leads of one window, in generated code."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for h in range(1, half + 1):
        d = F.lead(value, h).over(axis.w) - F.lag(value, h).over(axis.w)
        top, bottom = top + F.coalesce(d, F.lit(0.0)), bottom + F.when(d.isNotNull(), 2.0 * h).otherwise(0.0)
    return F.when((F.row_number().over(axis.w) > 1) & (bottom > 0), F.try_divide(top, bottom * dt))


def rate_of_change(value: str, axis: Axis = SERIES) -> Column:
    """The larger absolute slope to the sample before and after; null at the first, at the last only the one before."""
    v, t = F.col(value), F.col(axis.time)
    before = F.abs(F.try_divide(v - F.lag(v).over(axis.w), t - F.lag(t).over(axis.w)))
    after = F.abs(F.try_divide(F.lead(v).over(axis.w) - v, F.lead(t).over(axis.w) - t))
    last = F.lead(t).over(axis.w).isNull()
    after = F.when(last, F.lit(0.0)).otherwise(after)
    return F.when(before.isNotNull() & after.isNotNull(), F.greatest(before, after))


def median_filter(value: str, half: int, axis: Axis = SERIES) -> Column:
    """The median of half samples to each side and the own one; at the ends of those that are there."""
    return F.expr(f"percentile({value}, 0.5) OVER (PARTITION BY {', '.join(axis.keys)} ORDER BY {', '.join(axis.order)} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)")


def smoothing_weights(half: int, order: int = 2) -> list[float]:
    """Weights of the least-squares polynomial's value at the middle of 2 half + 1 points (Savitzky and Golay, 1964)."""
    at = np.arange(-half, half + 1)
    return np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0].tolist()


def polynomial_smooth(value: str, half: int, order: int = 2, axis: Axis = SERIES) -> Column:
    """A fixed filter; null within half samples of an end or of a missing value."""
    total = F.lit(0.0)
    for k, weight in zip(range(-half, half + 1), smoothing_weights(half, order), strict=True):
        total = total + F.lead(value, k).over(axis.w) * weight if k else total + F.col(value) * weight
    return total


def mad(df: DataFrame, value: str, axis: Axis = SERIES) -> DataFrame:
    """Adds med_err (value less the series' median) and mad (the median of its size)."""
    keys = ", ".join(axis.keys)
    df = df.withColumn("med_err", F.col(value) - F.expr(f"percentile({value}, 0.5) OVER (PARTITION BY {keys})"))
    return df.withColumn("mad", F.expr(f"percentile(abs(med_err), 0.5) OVER (PARTITION BY {keys})"))


def median_sigma(df: DataFrame, value: str, axis: Axis = SERIES) -> DataFrame:
    """Per series: sigma = sqrt(median(v^2) - median(v)^2), null if that is negative; below 1e-8 by means instead."""
    g = df.groupBy(*axis.keys).agg(F.expr(f"percentile({value} * {value}, 0.5)").alias("m2"), F.expr(f"percentile({value}, 0.5)").alias("m1"), F.avg(F.col(value) * F.col(value)).alias("a2"), F.avg(value).alias("a1"))
    by_median = F.when(F.col("m2") >= F.col("m1") ** 2, F.sqrt(F.col("m2") - F.col("m1") ** 2))
    by_mean = F.sqrt(F.greatest(F.lit(0.0), F.col("a2") - F.col("a1") ** 2))
    return g.select(*axis.keys, F.when(by_median < 1e-8, by_mean).otherwise(by_median).alias("sigma"))


#: Rounds after which the median form ends as it is, converged or not.
MEDIAN_ROUNDS = 30


def threshold_of(v: np.ndarray, start: float, c: float, *, robust: bool = True) -> tuple[float, float]:
    """Threshold and onset of some speeds (missing ones don't count), by rounds of centre + factor * spread of those below the threshold
    until it moves by 1 at most. robust: median and normal-scaled MAD, factor 2 c, onset factor c, MEDIAN_ROUNDS at most; otherwise
    mean and population sigma, factor c, onset factor 3, without a limit (an error where thresholds come back in a cycle). Nothing
    below the threshold: it stays, and the onset is missing. A new threshold of 0 doesn't count."""
    v = v[np.isfinite(v)]
    threshold, seen = start, set()
    for n in count(1):
        below = v[v < threshold]
        centre = spread = np.nan
        if len(below):
            centre = float(np.median(below) if robust else below.mean())
            spread = float(np.median(np.abs(below - centre)) * 1.482602218505602 if robust else below.std())
        new, onset = centre + (2 * c if robust else c) * spread, centre + (c if robust else 3) * spread
        moved = 0.0 if not new else abs(new - threshold)
        seen.add(threshold)
        if new and np.isfinite(new):
            threshold = new
        if not moved > 1 or (robust and n == MEDIAN_ROUNDS):
            return threshold, onset
        if not robust and threshold in seen:
            raise ValueError(f"thresholds go round in a cycle at {threshold}")
    raise AssertionError


def adaptive_threshold(df: DataFrame, value: str, start: float, c: float, axis: Axis = SERIES, *, robust: bool = True) -> DataFrame:
    """Per series: threshold, onset, as threshold_of(). One shuffle of the one column; the rounds run on a series' array."""

    def one(rows: pa.Table) -> pa.Table:
        found = threshold_of(rows[value].to_numpy().astype(float), start, c, robust=robust)
        numbers = [pa.array([x], pa.float64(), from_pandas=True) for x in found]
        return pa.Table.from_arrays([*(rows[k].slice(0, 1).combine_chunks() for k in axis.keys), *numbers], [*axis.keys, "threshold", "onset"])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in axis.keys] + ["threshold double, onset double"])
    return df.select(*axis.keys, F.col(value).cast("double").alias(value)).groupBy(*axis.keys).applyInArrow(one, schema)


def with_threshold(df: DataFrame, value: str, start: float, c: float, axis: Axis = SERIES, *, robust: bool = True) -> DataFrame:
    """df with threshold and onset of the row's series, as threshold_of(): the rows pass through, so df isn't read twice and a
    partitioning by the series stays."""
    from pyspark.sql import types as T

    def each(rows: pa.Table) -> pa.Table:
        found = threshold_of(rows[value].to_numpy().astype(float), start, c, robust=robust)
        for name, x in zip(("threshold", "onset"), found, strict=True):
            rows = rows.append_column(name, pa.array(np.full(len(rows), x), pa.float64(), from_pandas=True))
        return rows

    return df.groupBy(*axis.keys).applyInArrow(each, T.StructType([*df.schema.fields, T.StructField("threshold", T.DoubleType()), T.StructField("onset", T.DoubleType())]))


def null_insane(df: DataFrame, columns: list[str], speed: str, acceleration: str, most_speed: float, most_acceleration: float, k: int, axis: Axis = SERIES) -> DataFrame:
    """Columns become null where speed or acceleration is at or over its limit, or any of the columns is missing, and k samples around."""
    from gazeflow.operators.runs import null_dilated

    wild = F.coalesce((F.col(speed) >= most_speed) | (F.abs(F.col(acceleration)) >= most_acceleration), F.lit(False))
    df = df.select(*(F.when(~wild, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
    return null_dilated(df, columns, k, axis)


def pearson_from_start(a: DataFrame, b: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per key: r over the pairs of n-th values where both are known, n_good, n (of the shorter one). An equi-join on (keys, place)."""
    from pyspark.sql import Window as W

    place = lambda df, name: df.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_n"), F.col(value).alias(name))
    both = place(a, "_a").join(place(b, "_b"), [*keys, "_n"])
    good = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy(*keys).agg(F.corr(F.when(good, F.col("_a")), F.when(good, F.col("_b"))).alias("r"), F.count_if(good).alias("n_good"), F.count(F.lit(1)).alias("n"))


def samples_of(seconds: float, rate: float) -> int:
    """Samples of a duration, cut to a whole number; of an odd filter window see odd_samples()."""
    return int(seconds * rate)


def odd_samples(seconds: float, rate: float, least: int = 3) -> int:
    n = max(least, int(seconds * rate))
    return n if n % 2 else n + 1
