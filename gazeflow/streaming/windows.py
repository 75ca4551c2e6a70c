"""Windows of time, over batches and streams alike, and online run detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(df: DataFrame, time: str, keys: list[str], width: str, aggs: list[Column], *, slide: str | None = None, late: str | None = None) -> DataFrame:
    """keys, start, end and aggregates of windows of width (sliding, if slide). On a stream give late, the watermark's delay."""
    df = df.withWatermark(time, late) if late else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return _with_ends(df.groupBy(*keys, w.alias("_w")).agg(*aggs), keys)


def sessions(df: DataFrame, time: str, keys: list[str], gap: str, aggs: list[Column], *, late: str | None = None) -> DataFrame:
    """Windows that end where nothing comes for gap."""
    df = df.withWatermark(time, late) if late else df
    return _with_ends(df.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*aggs), keys)


def _with_ends(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *df.columns[len(keys) + 1 :])


def online_runs(df: DataFrame, key: str, time: str, value: str, threshold: float, *, late: str = "1 hour") -> DataFrame:
    """Runs of value > threshold of a stream, each when it ends: key, stsec, ensec, n, peak. The state of a key is its open run; it closes at the
    first sample that isn't above, or when the watermark has passed its last sample."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st, en, n, peak = state.get if state.exists else (0.0, 0.0, 0, 0.0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], st, en, n, peak))
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("t")
            for t, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
                if v is not None and v > threshold:
                    st, en, n, peak = (t, t, 1, v) if n == 0 else (st, t, n + 1, max(peak, v))
                elif n:
                    out.append((k[0], st, en, n, peak))
                    n = 0
            if n:
                state.update((st, en, n, peak))
                state.setTimeoutTimestamp(max(int(en * 1000) + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "stsec", "ensec", "n", "peak"])

    kind = dict(df.dtypes)[key]
    timed = df.withWatermark(time, late).select(key, time, (F.unix_micros(time) / 1e6).alias("t"), F.col(value).cast("double").alias("v"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, stsec double, ensec double, n long, peak double", "st double, en double, n long, peak double", "append", GroupStateTimeout.EventTimeTimeout)
