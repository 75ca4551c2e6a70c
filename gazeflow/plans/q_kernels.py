"""Queries: message logs, and the kernels that run as one Arrow task per series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeflow import expectations
from gazeflow.operators import cleaning, detect, kernels, kinematics, messages, timing
from gazeflow.series import SERIES, Axis

from .common import D, W, r6, rounded, samples

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _messages(spark, d):
    """A tracker log made of events: VID starts and ends, BLK starts and ends, FMRI triggers."""
    s = samples(spark, d).select("series", "t", "pos", "lab", "k")
    body = F.when(F.col("lab") == "signup", F.concat(F.lit("VID S clip XPX="), F.col("k").cast("string"), F.lit(" YPX=7 T=")))
    body = body.when(F.col("lab") == "purchase", "VID E clip").when(F.col("lab") == "error", "VID A clip")
    body = body.when((F.col("lab") == "click") & (F.col("k") % 4 == 0), "BLK S free").when((F.col("lab") == "click") & (F.col("k") % 4 == 1), "BLK E")
    return messages.tagged(s.withColumn("message", body.otherwise(F.concat(F.lit("FMRI TIME="), F.col("k").cast("string")))))


_MSG = f"""WITH {D}, M AS (SELECT series, t, pos, k, lab, CASE WHEN lab = 'signup' THEN 'S' WHEN lab = 'purchase' THEN 'E' WHEN lab = 'error' THEN 'A' END AS kind FROM D)"""
_TRIAL = _MSG + f""", V AS (SELECT *, CASE kind WHEN 'S' THEN 'S' ELSE 'E' END AS s FROM M WHERE kind IS NOT NULL), K AS (SELECT * FROM (SELECT *, lag(s) OVER {W} AS p FROM V) WHERE (p IS NULL OR p <> s) AND NOT (p IS NULL AND s = 'E')),
N AS (SELECT *, lead(t) OVER {W} AS en, lead(kind) OVER {W} AS ek FROM K), T AS (SELECT series, t AS start, en AS "end", k, row_number() OVER {W} - 1 AS trial FROM N WHERE s = 'S' AND en IS NOT NULL AND ek <> 'A')"""
_BLOCK = f""", BK AS (SELECT *, CASE k % 4 WHEN 0 THEN 'S' ELSE 'E' END AS bk FROM M WHERE lab = 'click' AND k % 4 IN (0, 1)), BN AS (SELECT *, lead(bk) OVER {W} AS nk, lead(t) OVER {W} AS nt FROM BK),
LASTS AS (SELECT series, max(t) AS last FROM D GROUP BY series), B AS (SELECT series, t AS start, CASE nk WHEN 'E' THEN nt WHEN 'S' THEN nt - 0.02 ELSE last END AS "end", row_number() OVER {W} - 1 AS block FROM BN JOIN LASTS USING (series) WHERE bk = 'S')"""


def _trials(spark, d):
    return messages.trials(_messages(spark, d), ["series"])


def _blocks(spark, d):
    ends = samples(spark, d).groupBy("series").agg(F.max("t").alias("last"))
    return messages.blocks(_messages(spark, d), ends, ["series"])


@query("message_trials", _TRIAL + """ SELECT series, trial, round(start, 6) AS start, round("end", 6) AS "end", 'clip' AS video, k::VARCHAR AS xpx FROM T""")
def message_trials(spark, d):
    t = _trials(spark, d)
    return t.select("series", "trial", r6("start").alias("start"), r6("end").alias("end"), "video", F.col("params")["XPX"].alias("xpx"))


@query("message_blocks", _MSG + _BLOCK + """ SELECT series, block, round(start, 6) AS start, round("end", 6) AS "end", 'free' AS kind FROM B""")
def message_blocks(spark, d):
    return rounded(_blocks(spark, d).select("series", "block", "start", "end", "kind"), "start", "end")


@query("trials_in_blocks", _TRIAL + _BLOCK + """, J AS (SELECT T.series, T.trial, T.start, CASE WHEN T."end" < B."end" THEN B.block END AS block FROM T ASOF LEFT JOIN B ON T.series = B.series AND T.start >= B.start)
SELECT series, trial, block, CASE WHEN block IS NOT NULL THEN row_number() OVER (PARTITION BY series, block ORDER BY start) - 1 END AS trial_in_block FROM J""")
def trials_in_blocks(spark, d):
    return messages.trials_in_blocks(_trials(spark, d), _blocks(spark, d), ["series"]).select("series", "trial", "block", "trial_in_block")


@query("trial_triggers", _TRIAL + """, G AS (SELECT series, t FROM M WHERE lab = 'view' OR (lab = 'click' AND k % 4 > 1)) SELECT T.series, trial, round(G.t, 6) AS trigger_t, round(start - G.t, 6) AS trigger_offset, G.t IS NOT NULL AS is_triggered FROM T ASOF LEFT JOIN G ON T.series = G.series AND T.start >= G.t""")
def trial_triggers(spark, d):
    t = _messages(spark, d).where("tag = 'FMRI'").select("series", "t")
    return rounded(messages.triggers(_trials(spark, d), t, ["series"]).select("series", "trial", "trigger_t", "trigger_offset", "is_triggered"), "trigger_t", "trigger_offset")


@query("tag_params", f"WITH {D} SELECT series, CAST(arg_max(k, (t, pos)) AS VARCHAR) AS time FROM D WHERE lab = 'view' OR (lab = 'click' AND k % 4 > 1) GROUP BY series")
def tag_params(spark, d):
    p = messages.tag_params(_messages(spark, d), "FMRI", ["series"])
    return p.select("series", F.col("params")["FMRI_TIME"].alias("time"))


@query("available_tags", f"WITH {D} SELECT CASE WHEN lab IN ('signup', 'purchase', 'error') THEN 'VID' WHEN lab = 'click' AND k % 4 < 2 THEN 'BLK' ELSE 'FMRI' END AS tag, count(*) AS n FROM D GROUP BY 1")
def available_tags(spark, d):
    return _messages(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("window_means_by_trial", f"WITH {D}, E AS (SELECT series, t AS st, lead(t) OVER {W} AS en, row_number() OVER {W} AS n FROM D WHERE lab = 'signup') SELECT E.series, n, count(*) AS samples, round(avg(D.v), 6) AS v FROM E JOIN D ON D.series = E.series AND D.t >= E.st AND D.t < E.en GROUP BY ALL")
def window_means_by_trial(spark, d):
    s = samples(spark, d)
    w = Axis(("series",), "t", ("pos",))
    starts = s.where("lab = 'signup'").select("series", "t", F.row_number().over(w.w).cast("long").alias("n"), F.lead("t").over(w.w).alias("en"))
    hit = timing.asof(s.select("series", "t", "v"), starts, ["n", "en"], Axis(("series",), "t", ())).where("n IS NOT NULL AND t < en")
    return rounded(hit.groupBy("series", "n").agg(F.count(F.lit(1)).alias("samples"), F.avg("v").alias("v")), "v")


@query("spline_resample")
def spline_resample(spark, d):
    return rounded(kernels.spline_resample(samples(spark, d), "x", 21600.0, SERIES), "t", "x")


@query("classifier_events")
def classifier_events(spark, d):
    v = detect.velocities(samples(spark, d), "x", "y", 0.25, 2)
    p = kernels.ClassifierParams(rate=100.0, start=400.0, noise=2.0, min_saccade=0.02, min_between=0.02, min_fixation=0.02)
    return rounded(kernels.classifier_events(v, SERIES, p, gap=1e6), "stsec", "ensec", "ampldva", "pvel", "avgvel")


@query("ahrs_euler")
def ahrs_euler(spark, d):
    s = samples(spark, d)
    s = s.select("series", "pos", (F.col("pos") * 0.01).alias("t"), F.col("x").alias("gyrx"), F.col("y").alias("gyry"), (F.col("v") - 50).alias("gyrz"), F.sin("k").alias("accx"), F.cos("k").alias("accy"), F.lit(1.0).alias("accz"))
    a = kernels.attitude(s, SERIES)
    return a.select("series", "pos", *(F.round(F.nanvl(c, F.lit(None).cast("double")), 4).alias(c) for c in ("roll", "pitch", "yaw")))



@query("single_gap_fill", f"WITH {D} SELECT event_id, round(coalesce(x, (lag(x) OVER {W} + lead(x) OVER {W}) / 2) + 1e-9, 4) AS x FROM D")
def single_gap_fill(spark, d):
    return samples(spark, d).select("event_id", F.round(cleaning.single_gaps_filled("x") + 1e-9, 4).alias("x"))


@query("row_mean", f"WITH {D} SELECT event_id, round((coalesce(x, 0) + coalesce(y, 0) + v) / (1 + (x IS NOT NULL)::INT + (y IS NOT NULL)::INT), 6) AS m FROM D")
def row_mean(spark, d):
    return samples(spark, d).select("event_id", r6(cleaning.row_mean("x", "y", "v")).alias("m"))


@query("centred_px", f"WITH {D} SELECT event_id, round(v - (series % 7 + 100) / 2.0, 6) AS cx_px, round(-(k - (series % 5 + 50) / 2.0), 6) AS cy_px FROM D")
def centred_px(spark, d):
    s = samples(spark, d)
    p = s.select("series").distinct().select("series", (F.col("series") % 7).alias("left"), F.lit(100).alias("right"), (F.col("series") % 5).alias("top"), F.lit(50).alias("bottom"))
    return rounded(cleaning.centred_px(s, p, ["series"], "v", "k").select("event_id", "cx_px", "cy_px"), "cx_px", "cy_px")


@query("clean_events", "SELECT event_id, CASE event_type WHEN 'click' THEN 'SACC' WHEN 'view' THEN 'FIXA' WHEN 'error' THEN 'BLNK' ELSE upper(event_type) END AS label, CASE user_id % 3 WHEN 0 THEN 'L' ELSE 'R' END AS eye, round(value / 1000, 6) AS stsec, round((value * 2 + 1) / 1000, 6) AS ensec, round((value * 2 + 1) / 1000 - value / 1000, 6) AS dursec FROM events WHERE user_id % 3 < 2")
def clean_events(spark, d):
    s = samples(spark, d)
    kind = F.when(F.col("lab") == "click", "saccade").when(F.col("lab") == "view", "fixation").when(F.col("lab") == "error", "blink").otherwise(F.col("lab"))
    e = s.select("event_id", kind.alias("type"), F.col("v").alias("start"), (F.col("v") * 2 + 1).alias("end"), (F.col("series") % 3).cast("int").alias("eye"))
    return rounded(cleaning.clean_events(e).select("event_id", "label", "eye", "stsec", "ensec", "dursec"), "stsec", "ensec", "dursec")


@query("insane_values", f"WITH {D}, A AS (SELECT *, sqrt(pow(x - lag(x) OVER {W}, 2)) AS sp FROM D), B AS (SELECT *, sp - lag(sp) OVER {W} AS ac FROM A), C AS (SELECT *, coalesce(sp >= 80 OR abs(ac) >= 100, false) AS wild FROM B), E AS (SELECT *, CASE WHEN NOT wild THEN x END AS x2, CASE WHEN NOT wild THEN y END AS y2 FROM C), M AS (SELECT *, max(x2 IS NULL OR y2 IS NULL) OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM E) SELECT event_id, CASE WHEN NOT m THEN x2 END AS x, CASE WHEN NOT m THEN y2 END AS y FROM M")
def insane_values(spark, d):
    w = timing.SERIES.w
    s = samples(spark, d).withColumn("sp", F.abs(F.col("x") - F.lag("x").over(w)))
    s = s.withColumn("ac", F.col("sp") - F.lag("sp").over(w))
    return kinematics.null_insane(s, ["x", "y"], "sp", "ac", 80.0, 100.0, 1).select("event_id", "x", "y")


@query("pearson_from_start", f"WITH {D}, A AS (SELECT series // 2 AS pair, pos, x FROM D WHERE series % 2 = 0), B AS (SELECT series // 2 AS pair, pos, x FROM D WHERE series % 2 = 1) SELECT pair, round(corr(A.x, B.x), 4) AS r, count(*) FILTER (WHERE A.x IS NOT NULL AND B.x IS NOT NULL) AS n_good, count(*) AS n FROM A JOIN B USING (pair, pos) GROUP BY pair")
def pearson_from_start(spark, d):
    s = samples(spark, d).withColumn("pair", F.expr("series div 2"))
    out = kinematics.pearson_from_start(s.where("series % 2 = 0"), s.where("series % 2 = 1"), ["pair"], "x", ["t", "pos"])
    return out.withColumn("r", F.round("r", 4))


@query("checked_series", f"WITH {D} SELECT event_id, pos FROM D")
def checked_series(spark, d):
    s = expectations.without_column(samples(spark, d), "checked")
    return expectations.times_unique(expectations.times_known(s)).select("event_id", "pos")
