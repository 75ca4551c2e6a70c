"""Loading and SQL shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeflow.series import event_series, with_dropouts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """S with dropouts: series, event_id, t, v, lab, k, pos, x, y."""
    return with_dropouts(event_series(table(spark, d, "events")))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(r6(c).alias(c) if c in columns else F.col(c) for c in df.columns))


#: CTE for samples(): D.
D = """S AS (SELECT user_id AS series, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value AS v, event_type AS lab,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
D AS (SELECT *, CASE WHEN v > 147 THEN NULL ELSE v END AS x, CASE WHEN v > 147 THEN NULL ELSE k::DOUBLE END AS y FROM S)"""
W = "(PARTITION BY series ORDER BY t, pos)"
