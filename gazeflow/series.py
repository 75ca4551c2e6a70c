"""Series: rows of some keys in the order of time, and the windows over them. All windows of one axis share partitioning and order, so
Spark shuffles and sorts once for all operators that are chained on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """keys: columns of a series; time: its time; tiebreak: columns that make the order of equal times unique."""

    keys: tuple[str, ...] = ("series",)
    time: str = "t"
    tiebreak: tuple[str, ...] = ("pos",)

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    @property
    def w(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return W.partitionBy(*self.keys)

    def rows(self, first: int | None, last: int | None) -> WindowSpec:
        return self.w.rowsBetween(W.unboundedPreceding if first is None else first, W.unboundedFollowing if last is None else last)


SERIES = Axis()


def nan_to_null(c: Column) -> Column:
    """Missing is null everywhere; scans turn NaN into it."""
    return F.when(~F.isnan(c), c)


def ensure_columns(df: DataFrame, ddl: str) -> DataFrame:
    """df with all columns of a DDL schema, in its order: missing ones are typed nulls, a missing `eye` is ''."""
    fields = [x.strip().rsplit(" ", 1) for x in ddl.split(",")]
    return df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else (F.lit("") if n == "eye" else F.lit(None)).cast(t).alias(n) for n, t in fields))


def positions(df: DataFrame, axis: Axis, name: str = "pos") -> DataFrame:
    """Adds each row's place in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(axis.w) - 1).cast("long"))


def seconds_since(ts: str, origin: str = "2024-01-01") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{origin}', {ts}) / 1e6D")


def event_series(events: DataFrame) -> DataFrame:
    """The events table as series: series, t, v, lab, k, pos, event_id."""
    df = events.select(F.col("user_id").alias("series"), "event_id", seconds_since("ts").alias("t"), F.col("value").alias("v"), F.col("event_type").alias("lab"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return positions(df, Axis(tiebreak=("event_id",)))


def with_dropouts(series: DataFrame, limit: float = 147.0) -> DataFrame:
    """Adds x, y: v and k, missing where v is over the limit."""
    bad = F.col("v") > limit
    return series.withColumn("x", F.when(~bad, F.col("v"))).withColumn("y", F.when(~bad, F.col("k").cast("double")))
