"""Kernels whose next value depends on the last: a series is one Arrow task. A recording of hours is some 10^7 rows of a few columns; where kernels may
start anew after a gap, split_at_gaps() makes its stretches series of their own, which classifier_events(gap=) does."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeflow.series import Axis


def split_at_gaps(df: DataFrame, axis: Axis, gap: float, name: str = "part") -> DataFrame:
    """Adds the number of the stretch without a step over gap: kernels with keys (*keys, part) then run in parallel within a recording."""
    new = F.coalesce(F.col(axis.time) - F.lag(axis.time).over(axis.w) > gap, F.lit(False)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(axis.rows(None, 0))).drop("_new")


def quadratic_spline(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at points of the spline of degree 2 through (t, v): knots half-way between samples, one matrix with three bands and more at the ends."""
    n = len(t)
    if n == 1:
        return np.full(len(at), v[0])
    if n == 2:
        return v[0] + (v[1] - v[0]) * (at - t[0]) / (t[1] - t[0])
    inner = (t[1:-2] + t[2:-1]) / 2 if n > 3 else np.empty(0)
    knots = np.concatenate(([t[0]] * 3, inner, [t[-1]] * 3))
    basis = _basis(knots, t, n)
    rows = np.arange(n)
    first = np.clip(np.searchsorted(knots, t, "right") - 3, 0, n - 3)
    bands = np.zeros((5, n))  # bands[2 + i - j, j] of the matrix
    for k in range(3):
        j = first + k
        bands[2 + rows - j, j] = basis[:, k]
    c = _solve_banded(bands, v.copy())
    first = np.clip(np.searchsorted(knots, at, "right") - 3, 0, n - 3)
    return (_basis(knots, at, n) * np.stack([c[first + k] for k in range(3)], axis=1)).sum(axis=1)


def _basis(knots: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The three B-splines of degree 2 that aren't 0 at each x."""
    s = np.clip(np.searchsorted(knots, x, "right") - 1, 2, n - 1)
    out = np.zeros((len(x), 3))
    out[:, 0] = 1.0
    for d in (1, 2):
        saved = np.zeros(len(x))
        for r in range(d):
            right, left = knots[s + r + 1] - x, x - knots[s + 1 - d + r]
            part = out[:, r] / (right + left)
            out[:, r] = saved + right * part
            saved = left * part
        out[:, d] = saved
    return out


def _solve_banded(bands: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elimination without pivots: the collocation matrix of a spline is totally positive."""
    n = len(b)
    for j in range(n):
        for i in (j + 1, j + 2):
            if i < n and bands[2 + i - j, j]:
                f = bands[2 + i - j, j] / bands[2, j]
                for k in range(j, min(j + 3, n)):
                    if 0 <= 2 + i - k < 5 and 0 <= 2 + j - k:
                        bands[2 + i - k, k] -= f * bands[2 + j - k, k]
                b[i] -= f * b[j]
    for i in range(n - 1, -1, -1):
        for k in range(i + 1, min(i + 3, n)):
            b[i] -= bands[2 + i - k, k] * b[k]
        b[i] /= bands[2, i]
    return b


def spline_resample(samples: DataFrame, value: str, step: float, axis: Axis) -> DataFrame:
    """keys, i, t, value on a regular grid from each series' first to its last time, by a spline of degree 2 through its samples (of equal times the
    mean). Series without samples give no rows."""
    kinds = dict(samples.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=[value]).groupby(axis.time, as_index=False)[value].mean().sort_values(axis.time)
        t, v = known[axis.time].to_numpy(float), known[value].to_numpy(float)
        if not len(t):
            return pd.DataFrame(columns=[*axis.keys, "i", axis.time, value])
        at = t[0] + step * np.arange(int(np.floor((t[-1] - t[0]) / step + 1e-9)) + 1)
        out = pd.DataFrame({"i": np.arange(len(at)), axis.time: at, value: quadratic_spline(t, v, at)})
        for k in reversed(axis.keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {kinds[k]}" for k in axis.keys] + [f"i long, {axis.time} double, {value} double"])
    return samples.select(*axis.keys, axis.time, value).groupBy(*axis.keys).applyInPandas(run, schema)


def low_pass(x: np.ndarray, rate: float, cutoff: float, order: int = 5) -> np.ndarray:
    """A Butterworth low-pass run forwards and backwards, as a chain of first- and second-order sections; the ends are padded by odd reflection."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    pad = min(len(x) - 1, 6 * (order + 1))
    if pad < 1:
        return x.copy()
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    sections = []
    for k in range((order + 1) // 2):
        if order % 2 and k == order // 2:
            a0 = 2 * rate + warped
            sections.append((warped / a0, warped / a0, 0.0, (warped - 2 * rate) / a0, 0.0))
        else:
            q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
            c = 2 * rate
            a0 = c * c + q * warped * c + warped * warped
            sections.append((warped**2 / a0, 2 * warped**2 / a0, warped**2 / a0, 2 * (warped**2 - c * c) / a0, (c * c - q * warped * c + warped**2) / a0))
    for _ in range(2):
        for b0, b1, b2, a1, a2 in sections:
            z1, z2 = y[0] * (1 - b0), y[0] * (b2 - a2)  # at rest at the first value
            out = np.empty_like(y)
            for i, v in enumerate(y.tolist()):
                o = b0 * v + z1
                z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
                out[i] = o
            y = out
        y = y[::-1]
    return y[pad : pad + len(x)]


@dataclass(frozen=True)
class ClassifierParams:
    """Samples per second and the limits of the velocity classifier (seconds, degrees)."""

    rate: float
    start: float = 100.0
    noise: float = 8.0
    min_saccade: float = 0.010
    min_between: float = 0.040
    window: float = 1.0
    min_pursuit: float = 0.040
    pursuit_speed: float = 2.0
    min_fixation: float = 0.040
    cutoff: float = 8.0


def velocity_threshold(v: np.ndarray, start: float, noise: float) -> tuple[float, float]:
    """Peak and onset threshold: median plus 2 (1) noise times the normal-scaled MAD of what is below, until it moves by 1 at most."""
    peak, onset = start, 0.0
    for _ in range(30):
        below = v[v < peak]
        if not len(below):
            break
        med = float(np.median(below))
        spread = float(np.median(np.abs(below - med))) * 1.482602218505602
        new, onset = med + 2 * noise * spread, med + noise * spread
        moved, peak = abs(new - peak), new or peak
        if moved <= 1:
            break
    return peak, onset


def classify(v: np.ndarray, x: np.ndarray, y: np.ndarray, p: ClassifierParams) -> list[tuple[str, int, int]]:
    """Labelled sample intervals [start, end) of one trace: SACC, then between them ISAC, FIXA and PURS. Candidate peaks are taken by their summed speed, each judged
    by thresholds of its surroundings and against those taken."""
    n, least = len(v), max(1, int(p.min_saccade * p.rate))
    filled = np.where(np.isfinite(v), v, np.nan)
    peak, _ = velocity_threshold(filled[np.isfinite(filled)], p.start, p.noise)
    taken = _saccades(filled, 0, n, peak, p, least, [])
    events = [("SACC", a, b) for a, b in taken]
    edges = [0, *(i for ab in sorted(taken) for i in ab), n]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        good = np.isfinite(filled[a:b])
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(int), [0]))))
        for s, e in zip((cuts[::2] + a).tolist(), (cuts[1::2] + a).tolist(), strict=True):
            small: list[tuple[int, int]] = []
            if e - s > 2 * int(p.min_between * p.rate):
                own, _ = velocity_threshold(filled[s:e], p.start, p.noise)
                small = _saccades(filled, s, e, own, p, least, [])
            events += [("ISAC", i, j) for i, j in small]
            inner = [s, *(i for ab in sorted(small) for i in ab), e]
            for i, j in zip(inner[::2], inner[1::2], strict=True):
                if j - i >= max(2, int(p.min_fixation * p.rate)):
                    events += _fix_or_pursuit(x[i:j], y[i:j], i, p)
    return sorted(events, key=lambda r: (r[1], r[2], r[0]))


def _saccades(v: np.ndarray, a: int, b: int, peak: float, p: ClassifierParams, least: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    high = np.concatenate(([False], np.nan_to_num(v[a:b], nan=-1.0) > peak, [False]))
    edges = np.flatnonzero(np.diff(high.astype(int)))
    found = sorted(((i + a, j + a) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), key=lambda ij: (-float(np.nansum(v[ij[0] : ij[1]])), ij))
    half, apart = int(p.window * p.rate / 2), int(p.min_between * p.rate)
    for i, j in found:
        near = v[max(a, i - half) : min(b, j + half)]
        near = near[np.isfinite(near)]
        own_peak, onset = velocity_threshold(near, p.start, p.noise)
        if not np.nanmax(v[i:j]) > own_peak:
            continue
        s, e = i, j
        while s > a and (v[s - 1] > onset or v[s - 1] < v[s]):
            s -= 1
        while e < b and (v[e] > onset or v[e] < v[e - 1]):
            e += 1
        if e - s < least or not np.isfinite(v[s:e]).all() or s <= a or e >= b or any(s < d + apart and c < e + apart for c, d in taken):
            continue
        if not (np.isfinite(v[s - 1]) and np.isfinite(v[e])):
            continue
        taken.append((s, e))
    return taken


def _fix_or_pursuit(x: np.ndarray, y: np.ndarray, at: int, p: ClassifierParams) -> list[tuple[str, int, int]]:
    fx, fy = low_pass(x, p.rate, min(p.cutoff, p.rate * 0.45)), low_pass(y, p.rate, min(p.cutoff, p.rate * 0.45))
    speed = np.hypot(np.diff(fx, prepend=fx[0]), np.diff(fy, prepend=fy[0])) * p.rate
    fast = speed > p.pursuit_speed
    least = max(1, int(p.min_pursuit * p.rate))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], fast.astype(int), [0]))))
    keep = [(i, j) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if j - i >= least]
    out: list[tuple[str, int, int]] = []
    last = 0
    for i, j in keep:
        if i - last >= least:
            out.append(("FIXA", last, i))
        elif out:
            i = out.pop()[1] if out[-1][0] == "PURS" else last
        else:
            i = 0
        out.append(("PURS", i, j))
        last = j
    if len(x) - last >= least or not out:
        out.append(("FIXA", last, len(x)))
    else:
        out[-1] = (out[-1][0], out[-1][1], len(x))
    return [(label, a + at, b + at) for label, a, b in out]


def classifier_events(df: DataFrame, axis: Axis, p: ClassifierParams, *, x: str = "x", y: str = "y", vel: str = "vel", gap: float | None = None) -> DataFrame:
    """Stretches without a step over gap are classified on their own, in tasks of their own. keys, label, stsec, ensec, stx, sty, enx, eny, ampldva, pvel, avgvel of each classified interval. Speeds are of the interval's own samples."""
    if gap is not None:
        parted = Axis((*axis.keys, "_part"), axis.time, axis.tiebreak)
        return classifier_events(split_at_gaps(df, axis, gap, "_part"), parted, p, x=x, y=y, vel=vel).drop("_part")
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis.order)
        t, gx, gy, v = (pdf[c].to_numpy(float) for c in (axis.time, x, y, vel))
        rows = []
        for label, a, b in classify(v, gx, gy, p):
            own = v[a:b]
            last = b - 1
            rows.append((label, t[a], t[min(b, len(t) - 1)], gx[a], gy[a], gx[last], gy[last], float(np.hypot(gx[last] - gx[a], gy[last] - gy[a])), float(np.nanmax(own)), float(np.nanmean(own))))
        out = pd.DataFrame(rows, columns=["label", "stsec", "ensec", "stx", "sty", "enx", "eny", "ampldva", "pvel", "avgvel"])
        for k in reversed(axis.keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {kinds[k]}" for k in axis.keys] + ["label string, stsec double, ensec double, stx double, sty double, enx double, eny double, ampldva double, pvel double, avgvel double"])
    return df.select(*axis.keys, *dict.fromkeys([*axis.order, x, y, vel])).groupBy(*axis.keys).applyInPandas(run, schema)


def orientation_step(q: np.ndarray, bias: np.ndarray, gyro: np.ndarray, acc: np.ndarray, mag: np.ndarray | None, dt: float, gain: float, bias_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """The next orientation (w, x, y, z) and gyroscope bias by the gradient-descent filter of Madgwick (2010). gyro: rad/s; acc, mag: any unit, a length
    of 0 doesn't correct; without bias_gain the bias stays."""
    w, x, y, z = q
    residuals, slopes = [], []
    size = np.linalg.norm(acc)
    if size > 0:
        residuals += list(np.array([2 * (x * z - w * y), 2 * (w * x + y * z), 2 * (0.5 - x * x - y * y)]) - acc / size)
        slopes += [[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [0, -4 * x, -4 * y, 0]]
    if mag is not None and (size := np.linalg.norm(mag)) > 0:
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        field = turn @ (mag / size)
        bx, bz = np.hypot(field[0], field[1]), field[2]  # the earth's field in the horizontal north and down
        residuals += list(np.array([2 * bx * (0.5 - y * y - z * z) + 2 * bz * (x * z - w * y), 2 * bx * (x * y - w * z) + 2 * bz * (w * x + y * z), 2 * bx * (w * y + x * z) + 2 * bz * (0.5 - x * x - y * y)]) - mag / size)
        slopes += [[-2 * bz * y, 2 * bz * z, -4 * bx * y - 2 * bz * w, -4 * bx * z + 2 * bz * x], [-2 * bx * z + 2 * bz * x, 2 * bx * y + 2 * bz * w, 2 * bx * x + 2 * bz * z, -2 * bx * w + 2 * bz * y], [2 * bx * y, 2 * bx * z - 4 * bz * x, 2 * bx * w - 4 * bz * y, 2 * bx * x]]
    down = np.zeros(4)
    if residuals:
        down = np.array(slopes).T @ np.array(residuals)
        size = np.linalg.norm(down)
        down = down / size if size > 0 else down
    if bias_gain:
        # The error's direction as an angular rate: twice the conjugate orientation times the gradient.
        e = down
        bias = bias + bias_gain * dt * 2 * np.array([w * e[1] - x * e[0] - y * e[3] + z * e[2], w * e[2] + x * e[3] - y * e[0] - z * e[1], w * e[3] - x * e[2] + y * e[1] - z * e[0]])
    gx, gy, gz = gyro - bias
    rate = 0.5 * np.array([-x * gx - y * gy - z * gz, w * gx + y * gz - z * gy, w * gy - x * gz + z * gx, w * gz + x * gy - y * gx]) - gain * down
    q = q + rate * dt
    return q / np.linalg.norm(q), bias


def attitude(df: DataFrame, axis: Axis, *, gain: float = 0.1, magnetometer: bool = False, bias_gain: float = 0.0, burn_in: float = 0.0, burn_in_rate: float = 100.0, acc_unit: float = 1.0) -> DataFrame:
    """Adds roll, pitch, yaw in degrees from gyrx..z (deg/s), accx..z (in units of acc_unit g) and, with magnetometer, magx..z, by orientation_step(). Rows with a
    missing input have nulls and the filter goes on after them; a missing field only leaves that correction out. burn_in: seconds for which the first
    whole sample is held, without turning, before the series starts."""
    inputs = ["gyrx", "gyry", "gyrz", "accx", "accy", "accz", *(["magx", "magy", "magz"] if magnetometer else [])]

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t = c[axis.time]
        gyro, acc = np.radians(np.stack([c[n] for n in inputs[:3]], 1)), np.stack([c[n] for n in inputs[3:6]], 1) * acc_unit
        mag = np.stack([c[n] for n in inputs[6:]], 1) if magnetometer else None
        out = np.full((len(t), 3), np.nan)
        q, bias, last = np.array([1.0, 0.0, 0.0, 0.0]), np.zeros(3), None
        for i in np.flatnonzero(np.isfinite(gyro).all(axis=1) & np.isfinite(acc).all(axis=1)).tolist():
            field = mag[i] if mag is not None and np.isfinite(mag[i]).all() else None
            if last is None:
                for _ in range(int(burn_in * burn_in_rate)):
                    q, _ = orientation_step(q, bias, np.zeros(3), acc[i], field, 1 / burn_in_rate, gain, 0.0)
            q, bias = orientation_step(q, bias, gyro[i], acc[i], field, 0.0 if last is None else t[i] - last, gain, bias_gain)
            last = t[i]
            w, x, y, z = q
            out[i] = np.degrees([np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), np.arcsin(np.clip(2 * (w * y - z * x), -1, 1)), np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))])
        return {"roll": out[:, 0], "pitch": out[:, 1], "yaw": out[:, 2]}

    from gazeflow.operators import traces

    return traces.arrow_columns(df, axis, ["roll", "pitch", "yaw"], run, [axis.time, *inputs])


def spike_filter(df: DataFrame, axis: Axis, value: str, name: str) -> DataFrame:
    """traces.without_spikes() as a column."""
    from gazeflow.operators import traces

    return traces.arrow_columns(df, axis, [name], lambda c: {name: traces.without_spikes(c[value])}, [value])
