"""Run-length operators: gaps and islands over series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeflow.series import SERIES, Axis


def with_runs(df: DataFrame, value: Column | str, axis: Axis = SERIES, *, split_nulls: bool = False, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal values that a row is in, from 1. Nulls are equal, or with split_nulls each its own run."""
    value = F.col(value) if isinstance(value, str) else value
    new = F.row_number().over(axis.w) == 1
    new = new | ~value.eqNullSafe(F.lag(value).over(axis.w))
    if split_nulls:
        new = new | value.isNull()
    flagged = df.withColumn("_new", new.cast("int"))
    return flagged.withColumn(name, F.sum("_new").over(axis.rows(None, 0))).drop("_new")


def run_table(df: DataFrame, value: Column | str, axis: Axis = SERIES, *, split_nulls: bool = False, until_next: bool = True) -> DataFrame:
    """One row per run: keys, run, v, sidx, lidx, eidx (exclusive), st, et, lent. et: the time of the next run's first sample, of
    the last run its own last sample; without until_next always the own last sample."""
    value = F.col(value) if isinstance(value, str) else value
    df = with_runs(df.withColumn("_v", value), "_v", axis, split_nulls=split_nulls)
    df = df.withColumn("_i", F.row_number().over(axis.w) - 1)
    runs = df.groupBy(*axis.keys, "run").agg(F.first("_v").alias("v"), F.min("_i").cast("long").alias("sidx"), F.count(F.lit(1)).alias("lidx"), F.min(axis.time).alias("st"), F.max(axis.time).alias("last"))
    follow = F.lead("st").over(W.partitionBy(*axis.keys).orderBy("run"))
    et = F.coalesce(follow, F.col("last")) if until_next else F.col("last")
    runs = runs.withColumn("eidx", F.col("sidx") + F.col("lidx")).withColumn("et", et).withColumn("lent", F.col("et") - F.col("st"))
    return runs.select(*axis.keys, "run", "v", "sidx", "lidx", "eidx", "st", "et", "lent")


def threshold_runs(df: DataFrame, value: str, threshold: float, axis: Axis = SERIES) -> DataFrame:
    """Runs of value > threshold and of the rest (null: the rest); et is the own last sample."""
    return run_table(df, F.coalesce(F.col(value) > threshold, F.lit(False)), axis, until_next=False)


def inverse_runs(runs: DataFrame, axis: Axis = SERIES) -> DataFrame:
    """One row per sample: keys, pos, v."""
    return runs.select(*axis.keys, F.explode(F.expr("sequence(sidx, eidx - 1)")).alias("pos"), "v")


def repeats_neighbour(value: str, axis: Axis = SERIES) -> Column:
    """True where a value equals the one before or after it."""
    v = F.col(value)
    return F.coalesce(v == F.lag(v).over(axis.w), F.lit(False)) | F.coalesce(v == F.lead(v).over(axis.w), F.lit(False))


def null_repeats(df: DataFrame, value: str, columns: list[str], most: int, axis: Axis = SERIES) -> DataFrame:
    """Columns become null in runs of one value longer than most samples."""
    df = with_runs(df, value, axis)
    n = F.count(F.lit(1)).over(W.partitionBy(*axis.keys, "run"))
    df = df.withColumn("_n", n)
    return df.select(*(F.when(~((F.col("_n") > most) & F.col(value).isNotNull()), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns if c not in ("run", "_n")))


def dilated(df: DataFrame, mask: Column, k: int, axis: Axis = SERIES, *, max_ignore: int | None = None, name: str = "dilated") -> DataFrame:
    """Adds mask widened by k samples to both sides; runs of at most max_ignore samples don't count."""
    df = df.withColumn("_m", F.coalesce(mask, F.lit(False)))
    if max_ignore is not None:
        df = with_runs(df, "_m", axis, name="_run")
        size = F.count(F.lit(1)).over(W.partitionBy(*axis.keys, "_run"))
        df = df.withColumn("_m", F.col("_m") & (size > max_ignore)).drop("_run")
    return df.withColumn(name, F.max("_m").over(axis.rows(-k, k))).drop("_m")


def null_dilated(df: DataFrame, columns: list[str], k: int, axis: Axis = SERIES, *, max_ignore: int | None = None) -> DataFrame:
    """Around missing samples of any of the columns, k to each side, all of them become null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    df = dilated(df, missing, k, axis, max_ignore=max_ignore, name="_d")
    return df.select(*(F.when(~F.col("_d"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns if c != "_d"))


def gap_filled(df: DataFrame, flag: str, least: int, axis: Axis = SERIES, name: str = "filled") -> DataFrame:
    """False runs of under least samples between true runs become true."""
    df = with_runs(df, flag, axis, name="_run")
    size, last = F.count(F.lit(1)).over(W.partitionBy(*axis.keys, "_run")), F.max("_run").over(axis.whole)
    inner = (F.col("_run") > 1) & (F.col("_run") < last)
    return df.withColumn("_n", size).withColumn(name, F.col(flag) | (inner & (F.col("_n") < least))).drop("_run", "_n")


def long_runs(df: DataFrame, flag: str, least: int, axis: Axis = SERIES, name: str = "long") -> DataFrame:
    """True runs of under least samples become false."""
    df = with_runs(df, flag, axis, name="_run")
    return df.withColumn(name, F.col(flag) & (F.count(F.lit(1)).over(W.partitionBy(*axis.keys, "_run")) >= least)).drop("_run")


def without_orphans(runs: DataFrame, axis: Axis, most: float, bracket: float) -> DataFrame:
    """runs: a table of runs of `bad`. Adds bad: v, or true for good runs shorter than most that are first, last or between two runs of
    at least bracket."""
    w = W.partitionBy(*axis.keys).orderBy("run")
    before, after = F.lag("lent").over(w), F.lead("lent").over(w)
    alone = before.isNull() | after.isNull() | ((before >= bracket) & (after >= bracket))
    return runs.withColumn("bad", F.col("v") | ((F.col("lent") < most) & alone))


def orphans_taken_in(df: DataFrame, flag: str, most: float, bracket: float, axis: Axis = SERIES, name: str = "bad") -> DataFrame:
    """As without_orphans(), on samples: adds flag, or true in false runs shorter than most that are first, last or between two runs of at
    least bracket. Windows over the series' partitioning only."""
    df = with_runs(df, flag, axis, name="_run")
    own = W.partitionBy(*axis.keys, "_run")
    df = df.withColumn("_next", F.lead(axis.time).over(axis.w)).withColumn("_first", ~F.coalesce(F.lag("_run").over(axis.w) == F.col("_run"), F.lit(False)))
    df = df.withColumn("_last", ~F.coalesce(F.lead("_run").over(axis.w) == F.col("_run"), F.lit(False)))
    end = F.max(F.when(F.col("_last"), F.coalesce("_next", F.col(axis.time)))).over(own)
    df = df.withColumn("_lent", end - F.min(axis.time).over(own))
    df = df.withColumn("_b", F.when(F.col("_first"), F.lag("_lent").over(axis.w))).withColumn("_a", F.when(F.col("_last"), F.lead("_lent").over(axis.w)))
    df = df.withColumn("_b", F.max("_b").over(own)).withColumn("_a", F.max("_a").over(own))
    alone = F.col("_b").isNull() | F.col("_a").isNull() | ((F.col("_b") >= bracket) & (F.col("_a") >= bracket))
    return df.withColumn(name, F.col(flag) | ((F.col("_lent") < most) & alone)).drop("_run", "_next", "_first", "_last", "_lent", "_b", "_a")


def touching_missing(df: DataFrame, flag: str, value: str, axis: Axis = SERIES, name: str = "clear") -> DataFrame:
    """True runs next to a sample whose value is missing become false."""
    df = with_runs(df, flag, axis, name="_run")
    own = W.partitionBy(*axis.keys, "_run")
    none = F.col(value).isNull()
    first = F.row_number().over(axis.w) > 1
    edge = (F.lag(none).over(axis.w) & first & ~F.lag("_run").over(axis.w).eqNullSafe(F.col("_run"))) | (F.lead(none).over(axis.w) & ~F.lead("_run").over(axis.w).eqNullSafe(F.col("_run")))
    df = df.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    return df.withColumn(name, F.col(flag) & ~F.max("_edge").over(own)).drop("_run", "_edge")


def two_state(df: DataFrame, on: Column, off: Column, axis: Axis = SERIES, name: str = "state") -> DataFrame:
    """1 from where on holds until off holds, else 0; neither keeps the state."""
    mark = F.when(on, 1).when(off, 0)
    return df.withColumn("_mark", mark).withColumn(name, F.coalesce(F.last("_mark", True).over(axis.rows(None, 0)), F.lit(0))).drop("_mark")


def hysteresis(df: DataFrame, core: Column, grown: Column, axis: Axis = SERIES, name: str = "vote") -> DataFrame:
    """True in the runs of grown that hold a core sample."""
    df = df.withColumn("_grown", F.coalesce(grown, F.lit(False))).withColumn("_core", F.coalesce(core, F.lit(False)))
    df = with_runs(df, "_grown", axis, name="_run")
    return df.withColumn(name, F.col("_grown") & F.max("_core").over(W.partitionBy(*axis.keys, "_run"))).drop("_run", "_grown", "_core")
