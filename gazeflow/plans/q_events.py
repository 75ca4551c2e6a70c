"""Queries: kinematics, robust statistics, event detection and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeflow.operators import detect, intervals, kinematics, runs, timing
from gazeflow.series import SERIES, Axis

from .common import D, W, r6, rounded, samples, table
from .q_series import _rle

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("diff_velocity", f"WITH {D} SELECT event_id, round(CASE WHEN pos = 0 THEN 0 ELSE sqrt(pow(x - lag(x) OVER {W}, 2) + pow(y - lag(y) OVER {W}, 2)) * 0.5 END, 6) AS vel FROM D")
def diff_velocity(spark, d):
    return samples(spark, d).select("event_id", r6(kinematics.diff_speed("x", "y", 0.5)).alias("vel"))


def _ek(c):
    d1, d2 = f"(lead({c}, 1) OVER {W} - lag({c}, 1) OVER {W})", f"(lead({c}, 2) OVER {W} - lag({c}, 2) OVER {W})"
    bottom = f"(CASE WHEN {d1} IS NULL THEN 0 ELSE 2.0 END + CASE WHEN {d2} IS NULL THEN 0 ELSE 4.0 END)"
    return f"CASE WHEN pos > 0 AND {bottom} > 0 THEN (coalesce({d1}, 0) + coalesce({d2}, 0)) / ({bottom} * 0.25) END"


_EK = f"WITH {D}, E AS (SELECT *, {_ek('x')} AS xvel, {_ek('y')} AS yvel FROM D), V AS (SELECT *, sqrt(xvel * xvel + yvel * yvel) AS vel FROM E)"


@query("ek_velocity", _EK + " SELECT event_id, round(xvel, 6) AS xvel, round(yvel, 6) AS yvel, round(vel, 6) AS vel FROM V")
def ek_velocity(spark, d):
    return rounded(detect.velocities(samples(spark, d), "x", "y", 0.25, 2).select("event_id", "xvel", "yvel", "vel"), "xvel", "yvel", "vel")


@query("ek_accel", _EK + f", A AS (SELECT event_id, {_ek('xvel')} AS ax, {_ek('yvel')} AS ay FROM V) SELECT event_id, round(sqrt(ax * ax + ay * ay), 6) AS acc FROM A")
def ek_accel(spark, d):
    v = detect.velocities(samples(spark, d), "x", "y", 0.25, 2)
    a = v.select("event_id", kinematics.multi_lag_velocity("xvel", 0.25, 2).alias("ax"), kinematics.multi_lag_velocity("yvel", 0.25, 2).alias("ay"))
    return a.select("event_id", r6(F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))).alias("acc"))


@query("rate_of_change", f"WITH {D}, R AS (SELECT event_id, abs((x - lag(x) OVER {W}) / (t - lag(t) OVER {W})) AS b, CASE WHEN lead(t) OVER {W} IS NULL THEN 0 ELSE abs((lead(x) OVER {W} - x) / (lead(t) OVER {W} - t)) END AS a FROM D) SELECT event_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END * 1000, 6) AS rate FROM R")
def rate_of_change(spark, d):
    return samples(spark, d).select("event_id", r6(kinematics.rate_of_change("x") * 1000).alias("rate"))


@query("median_filter", f"WITH {D} SELECT event_id, round(quantile_cont(x, 0.5) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS med FROM D")
def median_filter(spark, d):
    return samples(spark, d).select("event_id", F.round(kinematics.median_filter("x", 2), 4).alias("med"))


@query("savgol_fir", f"WITH {D} SELECT event_id, round((-3 * lag(v, 2) OVER {W} + 12 * lag(v) OVER {W} + 17 * v + 12 * lead(v) OVER {W} - 3 * lead(v, 2) OVER {W}) / 35.0, 4) AS smooth FROM D")
def savgol_fir(spark, d):
    return samples(spark, d).select("event_id", F.round(kinematics.polynomial_smooth("v", 2), 4).alias("smooth"))


@query("mad_by_series", f"WITH {D}, M AS (SELECT *, v - median(v) OVER (PARTITION BY series) AS e FROM D) SELECT event_id, round(e, 4) AS med_err, round(median(abs(e)) OVER (PARTITION BY series), 4) AS mad FROM M")
def mad_by_series(spark, d):
    m = kinematics.mad(samples(spark, d), "v")
    return m.select("event_id", F.round("med_err", 4).alias("med_err"), F.round("mad", 4).alias("mad"))


@query("median_sigma", f"WITH {D}, M AS (SELECT series, median(v * v) AS m2, median(v) AS m1, avg(v * v) AS a2, avg(v) AS a1 FROM D GROUP BY series), B AS (SELECT series, CASE WHEN m2 >= m1 * m1 THEN sqrt(m2 - m1 * m1) END AS b, sqrt(greatest(0, a2 - a1 * a1)) AS a FROM M) SELECT series, round(CASE WHEN b < 1e-8 THEN a ELSE b END, 6) AS sigma FROM B")
def median_sigma(spark, d):
    return rounded(kinematics.median_sigma(samples(spark, d), "v"), "sigma")


@query("zscore_by_series", f"WITH {D} SELECT event_id, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS z FROM D WINDOW w AS (PARTITION BY series)")
def zscore_by_series(spark, d):
    w = SERIES.whole
    return samples(spark, d).select("event_id", r6((F.col("v") - F.avg("v").over(w)) / F.stddev_samp("v").over(w)).alias("z"))


#: Rounds that the SQL unrolls; the median form ends with the 30th, and the mean form has converged by then on these tables.
_ROUNDS = 30


def _adaptive(src, start, c, robust):
    out = [f"T0 AS MATERIALIZED (SELECT DISTINCT series, {start}::DOUBLE AS thr, false AS done, NULL::DOUBLE AS onset FROM {src})"]
    for k in range(_ROUNDS):
        mid, spread = ("median(v)", "median(abs(v - c)) * 1.482602218505602") if robust else ("avg(v)", "stddev_pop(v)")
        out.append(f"B{k} AS MATERIALIZED (SELECT series, val AS v FROM {src} JOIN T{k} USING (series) WHERE val < thr)")
        out.append(f"C{k} AS MATERIALIZED (SELECT series, {mid} AS c FROM B{k} GROUP BY series)")
        out.append(f"S{k} AS MATERIALIZED (SELECT series, any_value(c) AS c, {spread} AS s FROM B{k} JOIN C{k} USING (series) GROUP BY series)")
        new, onset = (f"c + 2 * {c} * s", f"c + {c} * s") if robust else (f"c + {c} * s", "c + 3 * s")
        out.append(f"T{k + 1} AS MATERIALIZED (SELECT series, CASE WHEN done OR {new} IS NULL OR {new} = 0 THEN thr ELSE {new} END AS thr, done OR abs(CASE WHEN done OR {new} IS NULL OR {new} = 0 THEN thr ELSE {new} END - thr) <= 1 AS done, CASE WHEN done THEN onset ELSE {onset} END AS onset FROM T{k} LEFT JOIN S{k} USING (series))")
    return ", ".join(out)


@query("adaptive_threshold_mad", f"WITH {D}, X AS (SELECT series, v AS val FROM D), {_adaptive('X', 200, 3, True)} SELECT series, round(thr, 4) AS threshold, round(onset, 4) AS onset FROM T{_ROUNDS}")
def adaptive_threshold_mad(spark, d):
    a = kinematics.adaptive_threshold(samples(spark, d), "v", 200.0, 3.0)
    return a.select("series", F.round("threshold", 4).alias("threshold"), F.round("onset", 4).alias("onset"))


@query("adaptive_threshold_sigma", f"WITH {D}, X AS (SELECT series, v AS val FROM D), {_adaptive('X', 200, 2, False)} SELECT series, round(thr, 4) AS threshold, round(onset, 4) AS onset FROM T{_ROUNDS}")
def adaptive_threshold_sigma(spark, d):
    a = kinematics.adaptive_threshold(samples(spark, d), "v", 200.0, 2.0, robust=False)
    return a.select("series", F.round("threshold", 4).alias("threshold"), F.round("onset", 4).alias("onset"))


_BAD = f"""WITH {D}, S1 AS (SELECT *, CASE WHEN x IS NOT NULL THEN avg(x) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) END AS s FROM D),
S2 AS (SELECT *, abs((s - lag(s) OVER {W}) / (t - lag(t) OVER {W})) AS b, CASE WHEN lead(t) OVER {W} IS NULL THEN 0 ELSE abs((lead(s) OVER {W} - s) / (lead(t) OVER {W} - t)) END AS a FROM S1),
S3 AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS r FROM S2), S4 AS (SELECT *, median(r) OVER (PARTITION BY series) AS m FROM S3),
S5 AS (SELECT *, median(abs(r - m)) OVER (PARTITION BY series) AS md FROM S4), S6 AS (SELECT *, x IS NULL OR coalesce(r > m + 5 * md, false) AS p FROM S5),
P AS (SELECT event_id, series, t, pos, max(p) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS pre FROM S6),
"""


@query("bad_labels_pipeline", _BAD + _rle("pre", where="P").split(D + ", ", 1)[1] + ", N AS (SELECT *, lag(lent) OVER w AS b, lead(lent) OVER w AS a FROM R WINDOW w AS (PARTITION BY series ORDER BY run)) SELECT event_id, N.v OR (N.lent < 30000 AND (N.a IS NULL OR N.b IS NULL OR (N.a >= 50000 AND N.b >= 50000))) AS bad FROM G JOIN N USING (series, run)")
def bad_labels_pipeline(spark, d):
    return detect.bad_labels(samples(spark, d), "x", 10000.0, 1.0, 5.0, 1, 30000.0, 50000.0).select("event_id", "bad")


_EKV = _EK + """, Q AS (SELECT series, median(xvel * xvel) AS x2, median(xvel) AS x1, median(yvel * yvel) AS y2, median(yvel) AS y1 FROM V GROUP BY series),
O AS (SELECT V.*, coalesce(pow(xvel / CASE WHEN x2 > x1 * x1 THEN sqrt(x2 - x1 * x1) END, 2) + pow(yvel / CASE WHEN y2 > y1 * y1 THEN sqrt(y2 - y1 * y1) END, 2) > 1, false) AS o FROM V JOIN Q USING (series)),
""" + _rle("o", where="O").split(D + ", ", 1)[1].replace("F AS (", "F AS (").replace("G AS (", "G AS (")


@query("ek_votes", _EKV + " SELECT event_id, val AND lidx >= 2 AS ek FROM G JOIN (SELECT series, run, lidx FROM R) USING (series, run)")
def ek_votes(spark, d):
    return detect.ek_votes(detect.velocities(samples(spark, d), "x", "y", 0.25, 2), 1.0, 1).select("event_id", "ek")


_NH = _EK + f", X AS (SELECT series, vel AS val FROM V), {_adaptive('X', 400, 3, False)}, O AS (SELECT V.*, coalesce(vel > onset, false) AS o, coalesce(vel > thr, false) AS core FROM V JOIN T{_ROUNDS} USING (series)), " + _rle("o", where="O").split(D + ", ", 1)[1] + ", H AS (SELECT series, run, bool_or(core) AS core FROM G GROUP BY ALL)"


@query("nh_hysteresis", _NH + " SELECT event_id, G.val AND H.core AS nh FROM G JOIN H USING (series, run)")
def nh_hysteresis(spark, d):
    return detect.nh_votes(detect.velocities(samples(spark, d), "x", "y", 0.25, 2), 400.0, 3.0).select("event_id", "nh")


_VOTE = f"WITH {D}, C AS (SELECT *, ((v > 60)::INT + (k > 50)::INT + (lab IN ('click', 'view'))::INT) / 3.0 > 0.99 * 2 / 3.0 AS c FROM D), "
_V1 = _rle("c", where="C").split(D + ", ", 1)[1] + ", L AS (SELECT *, max(run) OVER (PARTITION BY series) AS last FROM R), C2 AS (SELECT G.event_id, G.series, G.t, G.pos, G.val OR (L.run > 1 AND L.run < L.last AND L.lidx < 2) AS c2 FROM G JOIN L USING (series, run)), "
_V2 = _rle("c2", where="C2").split(D + ", ", 1)[1].replace("F AS (", "F2 AS (").replace("FROM F)", "FROM F2)").replace("G AS (", "G2 AS (").replace("FROM G GROUP", "FROM G2 GROUP").replace("A AS (", "A2 AS (").replace("FROM A)", "FROM A2)").replace("R AS (", "R2 AS (")


@query("vote_consensus", _VOTE + _V1 + _V2 + " SELECT event_id, val AND lidx >= 2 AS sacc FROM G2 JOIN (SELECT series, run, lidx FROM R2) USING (series, run)")
def vote_consensus(spark, d):
    s = samples(spark, d).withColumn("a", F.col("v") > 60).withColumn("b", F.col("k") > 50).withColumn("c", F.col("lab").isin("click", "view"))
    return detect.consensus(s, ["a", "b", "c"], 2, 2).select("event_id", "sacc")


_TWO = f"WITH {D}, M AS (SELECT *, CASE WHEN v > 80 THEN 1 WHEN v < 40 THEN 0 END AS m FROM D), T AS (SELECT event_id, series, t, pos, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY series ORDER BY t, pos ROWS UNBOUNDED PRECEDING), 0) AS state FROM M), "


@query("peak_segments_two_state", _TWO + _rle("state", where="T").split(D + ", ", 1)[1] + " SELECT series, sidx, eidx, round(st, 6) AS st, round(et, 6) AS et FROM R WHERE v = 1")
def peak_segments_two_state(spark, d):
    s = runs.two_state(samples(spark, d), F.col("v") > 80, F.col("v") < 40)
    return rounded(runs.run_table(s, "state").where("v = 1").select("series", "sidx", "eidx", "st", "et"), "st", "et")


_ACC = f"WITH {D}, M AS (SELECT *, CASE WHEN v - lag(v) OVER {W} > 30 THEN 1 WHEN v - lag(v) OVER {W} < -30 THEN 0 END AS m FROM D), T AS (SELECT event_id, series, t, pos, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY series ORDER BY t, pos ROWS UNBOUNDED PRECEDING), 0) AS state FROM M), "


@query("accel_saccades", _ACC + _rle("state", where="T").split(D + ", ", 1)[1] + " SELECT series, round(st, 6) AS stsec, round(et, 6) AS ensec, round(lent, 6) AS dursec FROM R WHERE v = 1 AND lent < 90000")
def accel_saccades(spark, d):
    s = samples(spark, d).withColumn("acc", F.col("v") - F.lag("v").over(SERIES.w))
    return rounded(detect.between_peaks(s, "acc", 30.0, -30.0, 90000.0), "stsec", "ensec", "dursec")


_BL = f"""WITH {D}, P AS (SELECT *, x IS NULL AS val, coalesce(lag(t) OVER {W}, t) AS bt, CASE WHEN pos = 0 THEN x ELSE lag(x) OVER {W} END AS bx, CASE WHEN pos = 0 THEN y ELSE lag(y) OVER {W} END AS byy,
  coalesce(lead(t, 2) OVER {W}, lead(t) OVER {W}, t) AS at2, CASE WHEN lead(t, 2) OVER {W} IS NOT NULL THEN lead(x, 2) OVER {W} WHEN lead(t) OVER {W} IS NOT NULL THEN lead(x) OVER {W} ELSE x END AS ax,
  CASE WHEN lead(t, 2) OVER {W} IS NOT NULL THEN lead(y, 2) OVER {W} WHEN lead(t) OVER {W} IS NOT NULL THEN lead(y) OVER {W} ELSE y END AS ay FROM D),
N AS (SELECT *, CASE WHEN pos > 0 AND val = lag(val) OVER {W} THEN 0 ELSE 1 END AS new FROM P), G AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS run FROM N),
B AS (SELECT series, run, arg_min({{'t': bt, 'x': bx, 'y': byy}}, pos) AS a, arg_max({{'t': at2, 'x': ax, 'y': ay}}, pos) AS b FROM G WHERE val GROUP BY ALL)
SELECT series, 'BLNK' AS label, round(a.t, 6) AS stsec, round(b.t, 6) AS ensec, round(a.x, 6) AS stx, round(b.x, 6) AS enx, round(b.t - a.t, 6) AS dursec, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS ampldva FROM B"""


@query("blink_events", _BL)
def blink_events(spark, d):
    s = samples(spark, d).withColumn("bad", F.col("x").isNull())
    b = detect.blink_events(s, "bad", "x", "y")
    return rounded(b.select("series", "label", "stsec", "ensec", "stx", "enx", "dursec", "ampldva"), "stsec", "ensec", "stx", "enx", "dursec", "ampldva")


_EV = _rle("lab").split("R AS (")[0].replace("any_value(val) AS v", "any_value(val) AS v, max(G.v) AS pvel, avg(G.v) AS avgvel") + "E AS (SELECT series, v AS label, st AS stsec, coalesce(lead(st) OVER (PARTITION BY series ORDER BY run), lt) AS ensec, coalesce(lead(st) OVER (PARTITION BY series ORDER BY run), lt) - st AS dursec, pvel, avgvel FROM A)"


def _events(spark, d):
    return detect.events_by_label_runs(samples(spark, d))


@query("label_events", _EV + " SELECT series, label, round(stsec, 6) AS stsec, round(ensec, 6) AS ensec, round(dursec, 6) AS dursec, pvel, round(avgvel, 4) AS avgvel FROM E")
def label_events(spark, d):
    return rounded(_events(spark, d).withColumn("avgvel", F.round("avgvel", 4)), "stsec", "ensec", "dursec")


@query("isi", _EV + ", K AS (SELECT * FROM E WHERE label IN ('click', 'error')), L AS (SELECT *, coalesce(lag(ensec) OVER (PARTITION BY series ORDER BY stsec, ensec), 0) AS p, count(*) OVER (PARTITION BY series) AS n FROM K) SELECT series, round(p, 6) AS stsec, round(stsec, 6) AS ensec, round(stsec - p, 6) AS dursec, pvel, 'ISI' AS label FROM L WHERE n > 1")
def isi(spark, d):
    e = _events(spark, d).where(F.col("label").isin("click", "error"))
    return rounded(intervals.complement(e, ["series"]).select("series", "stsec", "ensec", "dursec", "pvel", "label"), "stsec", "ensec", "dursec")


def _groups(src, st, en, cmp):
    return f"""H AS (SELECT *, max({en}) OVER (PARTITION BY series ORDER BY {st}, {en} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {src}),
J AS (SELECT *, sum(CASE WHEN m IS NULL OR {cmp} THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY {st}, {en} ROWS UNBOUNDED PRECEDING) AS grp FROM H)"""


@query("envelope_merge", _EV + """, K AS (SELECT *, CASE WHEN label = 'error' THEN stsec - 40000 ELSE stsec END AS a, CASE WHEN label = 'error' THEN ensec + 40000 ELSE ensec END AS b FROM E WHERE label IN ('click', 'error')), """ + _groups("K", "a", "b", "a > m") + """
SELECT series, round(CASE WHEN count(*) > 1 THEN min(a) ELSE min(stsec) END, 6) AS stsec, round(CASE WHEN count(*) > 1 THEN max(b) ELSE max(ensec) END, 6) AS ensec,
  CASE WHEN count(*) > 1 THEN 'BLNK' ELSE any_value(label) END AS label, max(pvel) AS pvel, round(avg(avgvel) + 1e-9, 4) AS avgvel, count(*) AS n FROM J GROUP BY series, grp""")
def envelope_merge(spark, d):
    e = _events(spark, d).where(F.col("label").isin("click", "error"))
    m = intervals.merge_envelope(e, ["series"], 40000.0, F.col("label") == "error")
    return rounded(m.withColumn("avgvel", F.round(F.col("avgvel") + 1e-9, 4)), "stsec", "ensec")


@query("union_merge", _EV + ", K AS (SELECT * FROM E WHERE label IN ('click', 'error', 'view')), " + _groups("K", "stsec", "ensec", "stsec > m + 10000") + " SELECT series, round(min(stsec), 6) AS stsec, round(max(ensec), 6) AS ensec, max(pvel) AS pvel, count(*) AS n FROM J GROUP BY series, grp")
def union_merge(spark, d):
    e = _events(spark, d).where(F.col("label").isin("click", "error", "view"))
    return rounded(intervals.merge_union(e, ["series"], 10000.0), "stsec", "ensec")


_WIDE = _EV + ", K AS (SELECT series, stsec - 20000 AS stsec, ensec + 20000 AS ensec, pvel, avgvel FROM E WHERE label IN ('click', 'error')), "


@query("intersection_merge_base", _WIDE + _groups("K", "stsec", "ensec", "stsec >= m") + ", I AS (SELECT series, grp, max(stsec) AS a, min(ensec) AS b, max(pvel) AS pvel, avg(avgvel) AS avgvel, count(*) AS n FROM J GROUP BY series, grp) SELECT series, round(a, 6) AS stsec, round(b, 6) AS ensec, pvel, round(avgvel, 4) AS avgvel, n FROM I WHERE a < b")
def intersection_merge_base(spark, d):
    m = intervals.intersect_groups(_wide(spark, d), ["series"])
    return rounded(m.withColumn("avgvel", F.round("avgvel", 4)), "stsec", "ensec")


def _wide(spark, d):
    e = _events(spark, d).where(F.col("label").isin("click", "error"))
    return e.withColumn("stsec", F.col("stsec") - 20000.0).withColumn("ensec", F.col("ensec") + 20000.0)


@query("intersection_merge_recursive")
def intersection_merge_recursive(spark, d):
    return rounded(intervals.intersect_recursive(_wide(spark, d), ["series"]), "stsec", "ensec", "avgvel")


_BR = _EV + """, K AS (SELECT *, CASE label WHEN 'click' THEN 'SACC' WHEN 'error' THEN 'BLNK' WHEN 'view' THEN 'ISI' ELSE upper(label) END AS lb FROM E),
H AS (SELECT *, lb = 'ISI' AND dursec < 40000 AS glue FROM K), H2 AS (SELECT *, coalesce(lag(glue) OVER (PARTITION BY series ORDER BY stsec, ensec), false) AS pg, row_number() OVER (PARTITION BY series ORDER BY stsec, ensec) AS rn FROM H),
J AS (SELECT *, sum(CASE WHEN NOT (glue OR pg) OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY stsec, ensec ROWS UNBOUNDED PRECEDING) AS grp FROM H2)
SELECT series, round(min(stsec), 6) AS stsec, round(max(ensec), 6) AS ensec, CASE WHEN bool_or(lb = 'SACC') AND bool_or(lb = 'BLNK') THEN 'SACCBLNK' WHEN bool_or(lb = 'BLNK') THEN 'BLNK' WHEN bool_or(lb = 'SACC') THEN 'SACC' ELSE coalesce(min(lb) FILTER (WHERE lb <> 'ISI'), 'ISI') END AS label, count(*) AS n FROM J GROUP BY series, grp"""


@query("bridge_merge_labels", _BR)
def bridge_merge_labels(spark, d):
    names = F.when(F.col("label") == "click", "SACC").when(F.col("label") == "error", "BLNK").when(F.col("label") == "view", "ISI").otherwise(F.upper("label"))
    return rounded(intervals.bridge_merge(_events(spark, d).withColumn("label", names), ["series"], 40000.0), "stsec", "ensec")


@query("pair_markers", f"""WITH {D}, M AS (SELECT series, t, pos, CASE lab WHEN 'signup' THEN 'S' WHEN 'purchase' THEN 'E' ELSE 'A' END AS mark, CASE lab WHEN 'signup' THEN 'S' ELSE 'E' END AS kind FROM D WHERE lab IN ('signup', 'purchase', 'error')),
K AS (SELECT *, lag(kind) OVER {W} AS p FROM M QUALIFY (lag(kind) OVER {W}) IS NULL OR (lag(kind) OVER {W}) <> kind), L AS (SELECT * FROM K WHERE NOT (p IS NULL AND kind = 'E')),
N AS (SELECT *, lead(t) OVER {W} AS ensec, lead(mark) OVER {W} AS em FROM L) SELECT series, round(t, 6) AS stsec, round(ensec, 6) AS ensec FROM N WHERE kind = 'S' AND em IS NOT NULL AND em <> 'A'""")
def pair_markers(spark, d):
    s = samples(spark, d).where(F.col("lab").isin("signup", "purchase", "error"))
    s = s.withColumn("mark", F.when(F.col("lab") == "signup", "S").when(F.col("lab") == "purchase", "E").otherwise("A"))
    return rounded(intervals.pair_markers(s, ["series"]), "stsec", "ensec")


@query("first_second_occurrence", _EV + " SELECT series, label, round(stsec, 6) AS stsec, CASE row_number() OVER (PARTITION BY series, label ORDER BY stsec) WHEN 1 THEN 'Train' WHEN 2 THEN 'Test' ELSE 'ITI' END AS phase FROM E")
def first_second_occurrence(spark, d):
    n = F.row_number().over(Axis(("series", "label"), "stsec", ()).w)
    return _events(spark, d).select("series", "label", r6("stsec").alias("stsec"), F.when(n == 1, "Train").when(n == 2, "Test").otherwise("ITI").alias("phase"))


_SIDES = f"WITH {D}, P AS (SELECT series, event_id, t FROM D WHERE lab = 'purchase'), V AS (SELECT series, t, v, k FROM D WHERE lab = 'view')"


def _sides(spark, d):
    s = samples(spark, d)
    return s.where("lab = 'purchase'").select("series", "event_id", "t"), s.where("lab = 'view'").select("series", "t", "v", "k")


@query("asof_backward", _SIDES + " SELECT event_id, V.v, V.k, round(V.t, 6) AS t_r FROM P ASOF LEFT JOIN V ON P.series = V.series AND P.t >= V.t")
def asof_backward(spark, d):
    left, right = _sides(spark, d)
    return rounded(timing.asof(left, right, ["v", "k"], Axis(("series",), "t", ())).select("event_id", "v", "k", "t_r"), "t_r")


@query("asof_forward_strict", _SIDES + " SELECT event_id, V.v, V.k, round(V.t, 6) AS t_r FROM P ASOF LEFT JOIN V ON P.series = V.series AND P.t < V.t")
def asof_forward_strict(spark, d):
    left, right = _sides(spark, d)
    return rounded(timing.asof(left, right, ["v", "k"], Axis(("series",), "t", ()), direction="forward").select("event_id", "v", "k", "t_r"), "t_r")


@query("asof_nearest_tol", _SIDES + ", A AS (SELECT event_id, P.t, V.v, V.t AS tr FROM P ASOF LEFT JOIN V ON P.series = V.series AND P.t >= V.t), B AS (SELECT event_id, V.v, V.t AS tr FROM P ASOF LEFT JOIN V ON P.series = V.series AND P.t < V.t), C AS (SELECT event_id, A.t, CASE WHEN B.tr IS NULL OR A.t - A.tr <= B.tr - A.t THEN A.v ELSE B.v END AS v, CASE WHEN B.tr IS NULL OR A.t - A.tr <= B.tr - A.t THEN A.tr ELSE B.tr END AS tr FROM A JOIN B USING (event_id)) SELECT event_id, CASE WHEN abs(tr - t) <= 20000 THEN v END AS v FROM C")
def asof_nearest_tol(spark, d):
    left, right = _sides(spark, d)
    return timing.asof(left, right, ["v"], Axis(("series",), "t", ()), direction="nearest", tolerance=20000.0).select("event_id", "v")


_ORD = "O AS (SELECT o_custkey % 50 AS series, date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate) / 1e6 % 2592000 AS stsec, o_orderpriority AS label, o_orderkey FROM orders), I AS (SELECT series, stsec, stsec + 3600 * (1 + o_orderkey % 5) AS ensec, label, o_orderkey FROM O)"


def _orders(spark, d):
    o = table(spark, d, "orders")
    st = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1995-01-01', o_orderdate) / 1e6D") % 2592000
    return o.select((F.col("o_custkey") % 50).alias("series"), st.alias("stsec"), (st + 3600.0 * (1 + F.col("o_orderkey") % 5)).alias("ensec"), F.col("o_orderpriority").alias("label"), "o_orderkey")


@query("sample_in_interval_flags", f"WITH {D}, {_ORD} SELECT event_id, count(I.stsec) AS n_events, max(I.label) AS any_label FROM D LEFT JOIN I ON D.series = I.series AND t >= stsec AND t <= ensec GROUP BY event_id")
def sample_in_interval_flags(spark, d):
    s = samples(spark, d).select("event_id", "series", "t")
    e = _orders(spark, d).select("series", "stsec", "ensec", "label")
    flagged = intervals.range_flags(s, e, ["series"], 21600.0)
    top = s.join(e.withColumnRenamed("series", "_s"), (F.col("series") == F.col("_s")) & F.col("t").between(F.col("stsec"), F.col("ensec")), "left").groupBy("event_id").agg(F.max("label").alias("any_label"))
    return flagged.select("event_id", "n_events").join(top, "event_id")


@query("repeated_samples_in_intervals", f"WITH {D}, {_ORD}, P AS (SELECT series, floor(t / 3600) * 3600 AS t, row_number() OVER () AS n FROM D) SELECT series, t, count(I.stsec) AS n_events FROM P LEFT JOIN I USING (series) WHERE I.stsec IS NULL OR (t >= stsec AND t <= ensec) GROUP BY series, t, n UNION ALL SELECT series, t, 0 FROM P WHERE EXISTS (SELECT 1 FROM I WHERE I.series = P.series) AND NOT EXISTS (SELECT 1 FROM I WHERE I.series = P.series AND P.t >= stsec AND P.t <= ensec)")
def repeated_samples_in_intervals(spark, d):
    s = samples(spark, d).select("series", (F.floor(F.col("t") / 3600) * 3600).cast("double").alias("t"))
    return intervals.range_flags(s, _orders(spark, d).select("series", "stsec", "ensec", "label"), ["series"], 21600.0).select("series", "t", "n_events")


@query("trial_in_block", _EV + ", T AS (SELECT series, stsec, ensec, floor(stsec / 604800)::BIGINT AS blk FROM E), K AS (SELECT * FROM T WHERE ensec < (blk + 1) * 604800) SELECT series, blk, round(stsec, 6) AS stsec, row_number() OVER (PARTITION BY series, blk ORDER BY stsec) - 1 AS trial FROM K")
def trial_in_block(spark, d):
    e = _events(spark, d).withColumn("blk", F.floor(F.col("stsec") / 604800)).where(F.col("ensec") < (F.col("blk") + 1) * 604800)
    n = (F.row_number().over(Axis(("series", "blk"), "stsec", ()).w) - 1).cast("long")
    return e.select("series", "blk", r6("stsec").alias("stsec"), n.alias("trial"))


@query("interval_overlap_clip", _EV + f", {_ORD} SELECT E.series, o_orderkey, round(E.stsec, 6) AS l_st, round(greatest(E.stsec, I.stsec), 6) AS st, round(least(E.ensec, I.ensec), 6) AS en FROM E JOIN I ON E.series = I.series AND E.stsec < I.ensec AND E.ensec > I.stsec")
def interval_overlap_clip(spark, d):
    left = _events(spark, d).select("series", F.col("stsec").alias("l_st"), F.col("ensec").alias("l_en"))
    right = _orders(spark, d).select("series", F.col("stsec").alias("r_st"), F.col("ensec").alias("r_en"), "o_orderkey")
    return rounded(intervals.overlap_clip(left, right, ["series"], 43200.0).select("series", "o_orderkey", "l_st", "st", "en"), "l_st", "st", "en")


@query("om_votes")
def om_votes(spark, d):
    v = detect.velocities(samples(spark, d), "x", "y", 0.25, 2).select("series", "event_id", "t", "pos", "vel")
    return detect.om_votes(v, 120.0, 7200.0, 2).select("event_id", "om")


@query("flagship_event_pipeline")
def flagship_event_pipeline(spark, d):
    p = detect.EventParams(dt=0.25, half=2, nh_start=400.0, nh_factor=2.0, om_threshold=120.0, om_apart=7200.0)
    return rounded(detect.samples_to_events(samples(spark, d), "x", "y", p), "stsec", "ensec", "dursec")
