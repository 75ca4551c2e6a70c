"""Queries: cleaning, run-length operators, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeflow.functions import scalar as fn
from gazeflow.operators import cleaning, kernels, runs, timing
from gazeflow.series import SERIES

from .common import D, W, r6, rounded, samples, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("units_projection", f"WITH {D} SELECT event_id, round(t * 1000, 3) AS tmsec, round(t - min(t) OVER (PARTITION BY series), 6) AS t0, round(degrees(atan2(v, 0.6 * 3000)), 6) AS dva, round(v * 0.02, 6) AS dva_linear FROM D")
def units_projection(spark, d):
    s = samples(spark, d)
    return s.select("event_id", F.round(fn.sec_to_msec(F.col("t")), 3).alias("tmsec"), r6(F.col("t") - F.min("t").over(SERIES.whole)).alias("t0"), r6(fn.px_to_dva(F.col("v"), 3000.0, 0.6)).alias("dva"), r6(F.col("v") * 0.02).alias("dva_linear"))


@query("sentinel_to_null", f"WITH {D} SELECT event_id, CASE WHEN v > 300 OR v <= 0 OR lab = 'error' THEN NULL ELSE v END AS v, (v > 300 OR v <= 0 OR lab = 'error')::INT AS was_bad FROM D")
def sentinel_to_null(spark, d):
    s = samples(spark, d)
    bad = cleaning.is_sentinel("v", limit=300.0, positive=True, error=F.col("lab") == "error")
    return s.select("event_id", F.when(~bad, F.col("v")).alias("v"), bad.cast("int").alias("was_bad"))


@query("dedup_first_by_time", f"WITH {D} SELECT series, floor(t / 86400)::BIGINT AS day, event_id, v FROM D QUALIFY row_number() OVER (PARTITION BY series, floor(t / 86400) ORDER BY t, pos) = 1")
def dedup_first_by_time(spark, d):
    s = samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    return cleaning.first_per(s, ["series", "day"], ["t", "pos"]).select("series", "day", "event_id", "v")


@query("mean_by_time", f"WITH {D} SELECT series, floor(t / 86400)::BIGINT AS day, round(avg(v), 6) AS v, round(avg(k), 6) AS k, count(*) AS n FROM D GROUP BY ALL")
def mean_by_time(spark, d):
    s = samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    return rounded(s.groupBy("series", "day").agg(F.avg("v").alias("v"), F.avg("k").alias("k"), F.count(F.lit(1)).alias("n")), "v", "k")


_L = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, eye, x FROM (SELECT *, 'L' AS eye, l_discount AS x FROM lineitem UNION ALL SELECT *, 'R' AS eye, l_tax AS x FROM lineitem)"


@query("wide_to_long_channels", _L)
def wide_to_long_channels(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("x_left"), F.col("l_tax").alias("x_right"))
    return cleaning.eyes_to_rows(li, {"L": "_left", "R": "_right"}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "eye", "x")


@query("binocular_merge")
def binocular_merge(spark, d):
    s = samples(spark, d)
    left = s.select("series", "t", "pos", F.lit("L").alias("eye"), F.col("v").alias("x"), (F.col("v") > 100).alias("bad"))
    right = s.select("series", "t", "pos", F.lit("R").alias("eye"), (F.col("v") * 0.9 + F.col("k")).alias("x"), (F.col("k") % 7 == 0).alias("bad"))
    return rounded(cleaning.binocular(left.unionByName(right), ["series"], ["t", "pos"], "x").withColumn("x", F.round(F.col("x") + 1e-9, 3)), "t")


SQL["binocular_merge"] = f"""
WITH {D}, B AS (SELECT series, t, pos, v AS l, v * 0.9 + k AS r, v > 100 AS lb, k % 7 = 0 AS rb FROM D),
O AS (SELECT series, avg(((l + r) / 2) - l) FILTER (WHERE NOT lb AND NOT rb) AS ol, avg(((l + r) / 2) - r) FILTER (WHERE NOT lb AND NOT rb) AS og FROM B GROUP BY series)
SELECT series, round(t, 6) AS t, pos, lb AND rb AS bad, (lb <> rb) AS one_eye,
  round(1e-9 + CASE WHEN NOT lb AND NOT rb THEN (l + r) / 2 WHEN NOT lb THEN l + ol WHEN NOT rb THEN r + og END, 3) AS x FROM B JOIN O USING (series)"""


def _rle(value, where="D", until_next=True, split=False):
    same = f"NOT ({value} IS DISTINCT FROM lag({value}) OVER {W})" + (f" AND {value} IS NOT NULL" if split else "")
    et = "coalesce(lead(st) OVER (PARTITION BY series ORDER BY run), lt)" if until_next else "lt"
    return f"""WITH {D}, F AS (SELECT *, {value} AS val, CASE WHEN pos > 0 AND {same} THEN 0 ELSE 1 END AS new FROM {where}),
G AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS run FROM F),
A AS (SELECT series, run::BIGINT AS run, any_value(val) AS v, min(pos) AS sidx, count(*) AS lidx, min(t) AS st, max(t) AS lt FROM G GROUP BY series, run),
R AS (SELECT series, run, v, sidx, lidx, sidx + lidx AS eidx, st, {et} AS et, {et} - st AS lent FROM A)"""


_OUT = "round(st, 6) AS st, round(et, 6) AS et, round(lent, 6) AS lent"


@query("rle_labels", _rle("lab") + f" SELECT series, run, v, sidx, lidx, eidx, {_OUT} FROM R")
def rle_labels(spark, d):
    return rounded(runs.run_table(samples(spark, d), "lab"), "st", "et", "lent")


@query("rle_split_nulls", _rle("x", split=True) + f" SELECT series, run, v, sidx, lidx, eidx, {_OUT} FROM R")
def rle_split_nulls(spark, d):
    return rounded(runs.run_table(samples(spark, d), "x", split_nulls=True), "st", "et", "lent")


@query("cond_rle_missing", _rle("(x IS NULL)") + f" SELECT series, run, v, sidx, lidx, eidx, {_OUT} FROM R")
def cond_rle_missing(spark, d):
    return rounded(runs.run_table(samples(spark, d), F.col("x").isNull()), "st", "et", "lent")


@query("threshold_runs", _rle("coalesce(x > 60, false)", until_next=False) + f" SELECT series, run, v, sidx, lidx, eidx, {_OUT} FROM R")
def threshold_runs(spark, d):
    return rounded(runs.threshold_runs(samples(spark, d), "x", 60.0), "st", "et", "lent")


@query("inverse_rle_roundtrip", f"WITH {D} SELECT series, pos, lab AS v FROM D")
def inverse_rle_roundtrip(spark, d):
    return runs.inverse_runs(runs.run_table(samples(spark, d), "lab"))


@query("contiguous_flag", f"WITH {D} SELECT event_id, coalesce(lab = lag(lab) OVER {W}, false) OR coalesce(lab = lead(lab) OVER {W}, false) AS same FROM D")
def contiguous_flag(spark, d):
    return samples(spark, d).select("event_id", runs.repeats_neighbour("lab").alias("same"))


@query("suspicious_repeats", _rle("floor(v / 20)") + ", N AS (SELECT series, run, lidx FROM R) SELECT event_id, CASE WHEN lidx > 2 THEN NULL ELSE x END AS x, CASE WHEN lidx > 2 THEN NULL ELSE y END AS y FROM G JOIN N USING (series, run)")
def suspicious_repeats(spark, d):
    s = samples(spark, d).withColumn("q", F.floor(F.col("v") / 20))
    return runs.null_repeats(s, "q", ["x", "y"], 2).select("event_id", "x", "y")


_MASK = f"WITH {D} SELECT event_id, max(x IS NULL) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM D"


@query("dilate_missing", _MASK)
def dilate_missing(spark, d):
    return runs.dilated(samples(spark, d), F.col("x").isNull(), 2).select("event_id", "dilated")


@query("dilate_missing_minsize", _rle("(x IS NULL)") + ", M AS (SELECT event_id, series, t, pos, val AND lidx > 1 AS m FROM G JOIN (SELECT series, run, lidx FROM R) USING (series, run)) SELECT event_id, max(m) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM M")
def dilate_missing_minsize(spark, d):
    return runs.dilated(samples(spark, d), F.col("x").isNull(), 2, max_ignore=1).select("event_id", "dilated")


@query("dilate_nulls_columns", f"WITH {D}, M AS (SELECT *, max(x IS NULL OR y IS NULL) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM D) SELECT event_id, CASE WHEN NOT m THEN x END AS x, CASE WHEN NOT m THEN y END AS y FROM M")
def dilate_nulls_columns(spark, d):
    return runs.null_dilated(samples(spark, d), ["x", "y"], 1).select("event_id", "x", "y")


_FLAG = _rle("coalesce(x > 40, false)")


@query("gap_fill_runs", _FLAG + ", M AS (SELECT *, max(run) OVER (PARTITION BY series) AS last FROM R) SELECT event_id, G.val OR (run > 1 AND run < last AND lidx < 2) AS filled FROM G JOIN (SELECT series, run, lidx, last FROM M) USING (series, run)")
def gap_fill_runs(spark, d):
    s = samples(spark, d).withColumn("flag", F.coalesce(F.col("x") > 40, F.lit(False)))
    return runs.gap_filled(s, "flag", 2).select("event_id", "filled")


@query("min_duration_runs", _FLAG + " SELECT event_id, G.val AND lidx >= 3 AS long FROM G JOIN (SELECT series, run, lidx FROM R) USING (series, run)")
def min_duration_runs(spark, d):
    s = samples(spark, d).withColumn("flag", F.coalesce(F.col("x") > 40, F.lit(False)))
    return runs.long_runs(s, "flag", 3).select("event_id", "long")


@query("orphan_removal", _rle("(x IS NULL)") + ", N AS (SELECT *, lag(lent) OVER w AS b, lead(lent) OVER w AS a FROM R WINDOW w AS (PARTITION BY series ORDER BY run)) SELECT series, run, v OR (lent < 90000 AND (a IS NULL OR b IS NULL OR (a >= 20000 AND b >= 20000))) AS bad FROM N")
def orphan_removal(spark, d):
    r = runs.run_table(samples(spark, d), F.col("x").isNull())
    return runs.without_orphans(r, SERIES, 90000.0, 20000.0).select("series", "run", "bad")


@query("runs_touching_missing", _rle("coalesce(v > 40 AND v <= 147, false)") + f", E AS (SELECT series, run, bool_or(edge) AS edge FROM (SELECT series, run, coalesce((pos > 0 AND lag(x) OVER {W} IS NULL AND lag(run) OVER {W} <> run) OR (lead(run) OVER {W} IS NOT NULL AND lead(x) OVER {W} IS NULL AND lead(run) OVER {W} <> run), false) AS edge FROM G) GROUP BY ALL) SELECT event_id, val AND NOT edge AS clear FROM G JOIN E USING (series, run)")
def runs_touching_missing(spark, d):
    s = samples(spark, d).withColumn("flag", F.coalesce((F.col("v") > 40) & (F.col("v") <= 147), F.lit(False)))
    return runs.touching_missing(s, "flag", "x").select("event_id", "clear")


_GRID = f"""WITH {D}, B AS (SELECT series, min(t) AS a, ceil((max(t) - min(t)) / 21600)::BIGINT AS n FROM D GROUP BY series),
P AS (SELECT series, unnest(range(0, n + 1)) AS i, a FROM B), G AS (SELECT series, i, a + i * 21600.0 AS t FROM P)"""
_NEAR = """, K AS (SELECT series, t, x FROM D WHERE x IS NOT NULL), LO AS (SELECT G.series, G.i, G.t, K.t AS ta, K.x AS av FROM G ASOF LEFT JOIN K ON G.series = K.series AND G.t >= K.t),
HI AS (SELECT G.series, G.i, K.t AS tb, K.x AS bv FROM G ASOF LEFT JOIN K ON G.series = K.series AND G.t <= K.t)"""
_LIN = "CASE WHEN ta IS NULL THEN bv WHEN tb IS NULL THEN av WHEN ta = tb THEN av ELSE av + (bv - av) * (t - ta) / (tb - ta) END"


@query("grid_linear_resample", _GRID + _NEAR + f" SELECT series, i, round(t, 6) AS t, round({_LIN}, 6) AS x FROM LO JOIN HI USING (series, i)")
def grid_linear_resample(spark, d):
    s = samples(spark, d)
    return rounded(timing.resample(s, timing.grid(s, 21600.0), ["x"]), "t", "x")


@query("gap_limited_resample", _GRID + _NEAR + f" SELECT series, i, round(t, 6) AS t, CASE WHEN least(t - ta, tb - t) <= 10800 THEN round({_LIN}, 6) END AS x FROM LO JOIN HI USING (series, i)")
def gap_limited_resample(spark, d):
    s = samples(spark, d)
    return rounded(timing.resample(s, timing.grid(s, 21600.0), ["x"], max_gap=10800.0), "t", "x")


@query("ffill_labels", _GRID + " SELECT G.series, G.i, round(G.t, 6) AS t, K.lab FROM G ASOF LEFT JOIN (SELECT series, t, lab FROM D) K ON G.series = K.series AND G.t >= K.t")
def ffill_labels(spark, d):
    s = samples(spark, d)
    return rounded(timing.resample(s, timing.grid(s, 21600.0), [], ["lab"]), "t")


@query("bin_mean", f"WITH {D} SELECT series, floor((t - m) / 43200)::BIGINT AS bin, count(*) AS n, round(avg(v), 6) AS v FROM (SELECT *, min(t) OVER (PARTITION BY series) AS m FROM D) GROUP BY ALL")
def bin_mean(spark, d):
    return rounded(timing.bin_mean(samples(spark, d), 43200.0, ["v"]), "v")


@query("range_window_mean", _GRID + " SELECT G.series, i, round(G.t, 6) AS t, round(avg(D.v), 6) AS v FROM G LEFT JOIN D ON G.series = D.series AND D.t >= G.t - 10800 AND D.t < G.t + 10800 GROUP BY ALL")
def range_window_mean(spark, d):
    s = samples(spark, d)
    first = s.groupBy("series").agg(F.min("t").alias("a"))
    binned = s.join(first, "series").withColumn("i", F.floor((F.col("t") - F.col("a") + 10800.0) / 21600.0)).groupBy("series", "i").agg(F.avg("v").alias("v"))
    return rounded(timing.grid(s, 21600.0).join(binned, ["series", "i"], "left"), "t", "v")


@query("rolling_time_mean", f"WITH {D} SELECT event_id, round(avg(x) OVER w, 6) AS mean, count(x) OVER w AS n FROM D WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING)")
def rolling_time_mean(spark, d):
    s = samples(spark, d)
    return s.select("event_id", r6(timing.range_frame("avg(x)", 43200.0, 43200.0)).alias("mean"), timing.range_frame("count(x)", 43200.0, 43200.0).alias("n"))


@query("gaussian_smooth", f"WITH {D} SELECT a.event_id, round(sum(exp(-(a.t - b.t) * (a.t - b.t) / (2 * 20000.0 * 20000.0)) * b.x) / sum(exp(-(a.t - b.t) * (a.t - b.t) / (2 * 20000.0 * 20000.0))), 6) AS smooth FROM D a LEFT JOIN D b ON a.series = b.series AND b.x IS NOT NULL AND b.t BETWEEN a.t - 80000 AND a.t + 80000 GROUP BY a.event_id")
def gaussian_smooth(spark, d):
    return rounded(timing.gaussian_smooth(samples(spark, d), "x", 20000.0).select("event_id", "smooth"), "smooth")


@query("gaussian_smooth_all", f"WITH {D} SELECT a.event_id, round(sum(exp(-(a.t - b.t) * (a.t - b.t) / (2 * 20000.0 * 20000.0)) * b.x) / sum(exp(-(a.t - b.t) * (a.t - b.t) / (2 * 20000.0 * 20000.0))), 6) AS smooth FROM D a LEFT JOIN D b ON a.series = b.series AND b.x IS NOT NULL GROUP BY a.event_id")
def gaussian_smooth_all(spark, d):
    return rounded(timing.gaussian_smooth(samples(spark, d), "x", 20000.0, reach=None).select("event_id", "smooth"), "smooth")


@query("resample_gap_by_column", f"WITH {D}, N AS (SELECT event_id, t, x, lag(t) OVER {W} AS a, lead(t) OVER {W} AS b FROM D) SELECT event_id, x IS NOT NULL AS own FROM N")
def resample_gap_by_column(spark, d):
    """At the samples' own times a column with a gap of 0 is there where the sample has it; another without a limit has no part in that."""
    s = samples(spark, d)
    own = timing.resample(s, s.select("series", "t", F.col("event_id").alias("i"), "pos"), ["x", "v"], max_gap={"x": 0.0})
    return own.select(F.col("i").alias("event_id"), F.col("x").isNotNull().alias("own"))


@query("sample_rate_check", f"WITH {D}, F AS (SELECT series, t - lag(t) OVER {W} AS dt FROM D), M AS (SELECT series, count(*) AS n, quantile_cont(dt, 0.5) AS m, min(dt) AS mn FROM F GROUP BY series) SELECT series, any_value(n) AS n, round(any_value(m), 6) AS median_dt, round(any_value(mn), 6) AS min_dt, bool_and(coalesce(abs(dt - m) <= 1e-6 + 1e-3 * abs(m), true)) AS regular, any_value(CASE WHEN m > 0 THEN round(1 / m, 2) END) AS rate FROM F JOIN M USING (series) GROUP BY series")
def sample_rate_check(spark, d):
    return rounded(timing.sample_rate(samples(spark, d)), "median_dt", "min_dt")


@query("data_sufficiency", f"WITH {D} SELECT series, count(*) AS n, count(x) AS good, count(*) < 60 OR count(x) < 0.95 * count(*) OR count(x) < 60 AS not_enough FROM D GROUP BY series")
def data_sufficiency(spark, d):
    return cleaning.sufficiency(samples(spark, d), "x", ["series"], 0.95, 60)


@query("quantile_trim", f"WITH {D}, Q AS (SELECT series, quantile_cont(t, 0.95) AS q FROM D GROUP BY series), K AS (SELECT series, t, pos FROM D JOIN Q USING (series) WHERE t < q), L AS (SELECT series, t - lag(t) OVER {W} AS dt FROM K) SELECT series, count(*) AS n, round(max(dt), 6) AS max_gap FROM L GROUP BY series")
def quantile_trim(spark, d):
    kept = cleaning.below_quantile(samples(spark, d), "t", 0.95, ["series"])
    gap = kept.select("series", (F.col("t") - F.lag("t").over(SERIES.w)).alias("dt"))
    return rounded(gap.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("max_gap")), "max_gap")


@query("chunk_pages", f"WITH {D} SELECT event_id, floor((t - m) / 259200)::BIGINT AS chunk, floor(floor((t - m) / 259200) / 4)::BIGINT AS page FROM (SELECT *, min(t) OVER (PARTITION BY series) AS m FROM D)")
def chunk_pages(spark, d):
    return cleaning.chunked(samples(spark, d), 259200.0, 4).select("event_id", "chunk", "page")


@query("spike_filter_fold", f"""WITH RECURSIVE {D}, R(series, pos, x, raw, nxt) AS (
  SELECT series, pos, v, v, NULL::DOUBLE FROM D WHERE pos = 0
  UNION ALL SELECT D.series, D.pos, CASE WHEN N.v IS NULL THEN D.v WHEN (D.v > R.x AND D.v > N.v) OR (D.v < R.x AND D.v < N.v) THEN CASE WHEN abs(D.v - R.x) < abs(D.v - N.v) THEN R.x ELSE N.v END ELSE D.v END, D.v, N.v
  FROM R JOIN D ON D.series = R.series AND D.pos = R.pos + 1 LEFT JOIN D N ON N.series = D.series AND N.pos = D.pos + 1)
SELECT series, pos, x FROM R""")
def spike_filter_fold(spark, d):
    return kernels.spike_filter(samples(spark, d).select("series", "t", "pos", "v"), SERIES, "v", "x").select("series", "pos", "x")

