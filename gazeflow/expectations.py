"""Checks that fail a query where its input isn't what an operator needs. Each returns the rows as they were; a check that fails raises when the
rows are computed, with the series in the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeflow.series import SERIES, Axis


def expect(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    checked = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.withColumn("_ok", checked).where("_ok").drop("_ok")


def _named(text: str, axis: Axis) -> Column:
    return F.concat(F.lit(f"{text}: "), F.concat_ws("/", *(F.col(k).cast("string") for k in axis.keys)))


def times_known(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    return expect(df, F.col(axis.time).isNotNull(), _named("a time is missing", axis))


def times_unique(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    return expect(df, ~F.coalesce(F.lag(axis.time).over(axis.w) == F.col(axis.time), F.lit(False)), _named("two samples have one time", axis))


def regular(df: DataFrame, axis: Axis = SERIES) -> DataFrame:
    """Steps within 1e-6 + 0.1 % of the series' median step, and above 0."""
    d = df.withColumn("_dt", F.col(axis.time) - F.lag(axis.time).over(axis.w)).withColumn("_m", F.expr(f"percentile(_dt, 0.5) OVER (PARTITION BY {', '.join(axis.keys)})"))
    ok = F.col("_dt").isNull() | ((F.col("_dt") > 0) & (F.abs(F.col("_dt") - F.col("_m")) <= 1e-6 + 1e-3 * F.abs("_m")))
    return expect(d, ok, _named("irregular steps", axis)).drop("_dt", "_m")


def eyes_alike(df: DataFrame, keys: list[str], time: str, n: int = 2) -> DataFrame:
    """All times of a series have n eyes."""
    from pyspark.sql import Window as W

    return expect(df, F.count(F.lit(1)).over(W.partitionBy(*keys, time)) == n, F.concat(F.lit("eyes differ at "), F.col(time).cast("string")))


def without_column(df: DataFrame, name: str) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df
