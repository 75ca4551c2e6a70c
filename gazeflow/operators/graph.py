"""Rows that are connected by shared values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeflow.session import shared_dir


def clusters(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id, cluster: the smallest row_id of all rows that are connected by equal values of a column, over chains of any length. Nulls connect
    nothing.

    Each value links its rows to the smallest of them, so there are at most as many links as values that rows hold. Links then turn
    into stars by alternating large and small stars (Kiveris et al., 2014) until they stay as they are, which takes rounds in the
    logarithm of the longest chain. What a round makes, and each aggregate before it is joined, goes to the session's checkpoint
    folder: plans stay short and survive lost executors, and both sides of a join come straight from a shuffle, so Spark can
    split a frequent value."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    values = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)))
    held = df.select(F.col(row_id).alias("r"), F.explode(values).alias("k")).where("k.v IS NOT NULL").checkpoint()
    least = held.groupBy("k").agg(F.min("r").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "m").checkpoint()
    links = held.join(least, "k").where("r > m").select(F.col("r").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
    before = None
    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = links.union(links.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")).checkpoint()
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).checkpoint()
        small = large.join(down, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.union(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
    rows = df.select(F.col(row_id).alias("r"))
    return rows.join(links, F.col("r") == F.col("u"), "left").select(F.col("r").alias(row_id), F.coalesce("v", "r").alias("cluster"))
