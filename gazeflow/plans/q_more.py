"""Queries: periods and merges of events, trace preprocessing, flow fields, sources and sinks written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeflow.operators import cleaning, detect, intervals, messages, runs, study, timing, traces
from gazeflow.series import Axis
from gazeflow.session import shared_dir
from gazeflow.sources import files

from .common import D, r6, rounded, samples, table
from .q_events import _EV, _events, _groups, _sides

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("zero_based_time", f"WITH {D} SELECT event_id, round(t - min(t) OVER (PARTITION BY series), 6) AS t0 FROM D")
def zero_based_time(spark, d):
    return timing.zero_based(timing.zero_based(samples(spark, d))).select("event_id", r6("t0").alias("t0"))


@query("dilate_value", f"WITH {D} SELECT event_id, max(lab = 'signup') OVER (PARTITION BY series ORDER BY t, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM D")
def dilate_value(spark, d):
    return runs.dilated(samples(spark, d), F.col("lab") == "signup", 2, name="near").select("event_id", "near")


@query("look_back", f"WITH {D}, P AS (SELECT series, event_id, t FROM D WHERE lab = 'purchase'), V AS (SELECT series, t, v FROM D WHERE lab = 'view') SELECT event_id, CASE WHEN P.t - V.t <= 10000 THEN V.v END AS v FROM P ASOF LEFT JOIN V ON P.series = V.series AND P.t >= V.t")
def look_back(spark, d):
    left, right = _sides(spark, d)
    return timing.look_back(left, right, ["v"], Axis(("series",), "t", ()), 10000.0).select("event_id", "v")


@query("mean_first", f"WITH {D} SELECT series, round(avg(v), 6) AS v, round(avg(k), 6) AS k, arg_min(lab, pos) AS lab FROM D GROUP BY series")
def mean_first(spark, d):
    s = samples(spark, d).select("series", "pos", "v", "k", "lab")
    return rounded(study.mean_first(s, ["series"], ["pos"]).drop("pos"), "v", "k")


_PER = "P AS (SELECT s.series, p.p, p.p * 400000.0 + s.series * 1000.0 AS a, p.p * 400000.0 + s.series * 1000.0 + 500000.0 AS b FROM (SELECT DISTINCT series FROM D) s, (SELECT unnest(range(0, 6)) AS p) p)"


@query("regressors_by_stated_period", _EV + f", {_PER}, J AS (SELECT E.*, P.p FROM E JOIN P ON E.series = P.series AND a <= stsec AND ensec <= b) SELECT series, p, count(*) AS n, round(sum(dursec), 6) AS total, count(*) FILTER (WHERE pvel < 50) AS n_small, count(*) FILTER (WHERE pvel > 50) AS n_big, round(median(pvel), 4) AS med_size FROM J GROUP BY ALL")
def regressors_by_stated_period(spark, d):
    """Periods of their own for each series, which overlap: an event counts in each that holds it."""
    e = _events(spark, d)
    p = e.select("series").distinct().withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("p_st", F.col("p") * 400000.0 + F.col("series") * 1000.0).withColumn("p_en", F.col("p_st") + 500000.0)
    inside = intervals.within_periods(e, p, ["series"], 250000.0)
    g = study.regressors(inside, ["series", "p"], "dursec", "pvel", 50.0, F.lit(500000.0))
    return g.select("series", "p", "n", r6("total").alias("total"), "n_small", "n_big", F.round("med_size", 4).alias("med_size"))


_EYE = _EV + ", K AS (SELECT series, CASE label WHEN 'click' THEN 'SACC' WHEN 'error' THEN 'SACCBLNK' ELSE label END AS label, stsec, ensec, dursec, pvel, avgvel AS stx, 0.0 AS sty, pvel AS enx, 1.0 AS eny FROM E)"


def _eye_events(spark, d, names):
    lab = F.col("label")
    for a, b in names.items():
        lab = F.when(F.col("label") == a, b).otherwise(lab)
    e = _events(spark, d).withColumn("label", lab)
    return e.withColumn("stx", F.col("avgvel")).withColumn("sty", F.lit(0.0)).withColumn("enx", F.col("pvel")).withColumn("eny", F.lit(1.0))


@query("saccade_union_labels", _EYE + ", SA AS (SELECT * FROM K WHERE label LIKE 'SACC%'), " + _groups("SA", "stsec", "ensec", "stsec > m + 20000").strip() + """, GR AS (SELECT series, grp, CASE WHEN count(*) = 1 THEN any_value(label) WHEN bool_or(label = 'SACCBLNK') THEN 'SACCBLNK' ELSE 'SACC' END AS label, min(stsec) AS stsec, max(ensec) AS ensec, arg_min(stx, stsec) AS stx, arg_max(enx, (stsec, ensec)) AS enx, max(pvel) AS pvel, count(*) AS n FROM J GROUP BY series, grp)
SELECT series, label, round(stsec, 6) AS stsec, round(ensec, 6) AS ensec, pvel, n, round(sqrt(pow(enx - stx, 2) + 1), 4) AS ampl FROM GR UNION ALL SELECT series, label, round(stsec, 6), round(ensec, 6), pvel, 1, round(sqrt(pow(enx - stx, 2) + 1), 4) FROM K WHERE label NOT LIKE 'SACC%'""")
def saccade_union_labels(spark, d):
    m = intervals.merge_saccades(_eye_events(spark, d, {"click": "SACC", "error": "SACCBLNK"}), ["series"], 20000.0)
    return rounded(m.select("series", "label", "stsec", "ensec", "pvel", "n", F.round("ampldva", 4).alias("ampl")), "stsec", "ensec")


_BRIDGE = _EV + """, K AS (SELECT *, avgvel AS stx, pvel AS enx, CASE label WHEN 'click' THEN 'SACC' WHEN 'error' THEN 'BLNK' WHEN 'view' THEN 'ISI' ELSE upper(label) END AS lb0, sqrt(pow(pvel - avgvel, 2) + 1) AS amp FROM E),
K1 AS (SELECT *, CASE WHEN lb0 = 'BLNK' AND dursec < 30000 AND amp < 5 THEN 'ISI' ELSE lb0 END AS lb FROM K), K2 AS (SELECT *, lb = 'ISI' AND dursec < 40000 AS br FROM K1),
K3 AS (SELECT *, br OR coalesce(lag(br) OVER v, false) OR coalesce(lead(br) OVER v, false) AS mk FROM K2 WINDOW v AS (PARTITION BY series ORDER BY stsec, ensec)), K4 AS (SELECT *, mk AND coalesce(lag(mk) OVER (PARTITION BY series ORDER BY stsec, ensec), false) AS same FROM K3),
K5 AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY series ORDER BY stsec, ensec ROWS UNBOUNDED PRECEDING) AS grp FROM K4)
SELECT series, round(min(stsec), 6) AS stsec, round(max(ensec), 6) AS ensec, CASE WHEN bool_or(lb = 'SACC') AND bool_or(lb = 'BLNK') THEN 'SACCBLNK' WHEN bool_or(lb = 'BLNK') THEN 'BLNK' WHEN bool_or(lb = 'SACC') THEN 'SACC' ELSE coalesce(min(lb) FILTER (WHERE lb <> 'ISI'), 'ISI') END AS label,
  max(pvel) AS pvel, round(sqrt(pow(arg_max(enx, (stsec, ensec)) - arg_min(stx, (stsec, ensec)), 2) + 1), 4) AS ampl, count(*) AS n FROM K5 GROUP BY series, grp"""


@query("bridge_merge_chained", _BRIDGE)
def bridge_merge_chained(spark, d):
    e = _eye_events(spark, d, {"click": "SACC", "error": "BLNK", "view": "ISI"})
    e = e.withColumn("ampldva", F.sqrt((F.col("enx") - F.col("stx")) ** 2 + 1))
    m = intervals.bridge_merge_chained(e, ["series"], max_isi=40000.0, min_blink=30000.0, max_amplitude=5.0)
    return rounded(m.select("series", "stsec", "ensec", "label", "pvel", F.round("ampldva", 4).alias("ampl"), "n"), "stsec", "ensec")


_FLOW = "F AS (SELECT vec_id AS frame, (i - 1) // 8 AS i, (i - 1) % 8 AS j, embedding[i]::DOUBLE AS u, embedding[(i % 64) + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def _flow(spark, d):
    """A flow field of 8 x 8 points for each vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode(F.arrays_zip(F.col("embedding").alias("u"), F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)).alias("v"))).alias("p", "z"))
    return e.select("frame", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).alias("j"), F.col("z.u").cast("double").alias("u"), F.col("z.v").cast("double").alias("v"))


@query("flow_divergence", f"WITH {_FLOW}, G AS (SELECT frame, i, j, CASE WHEN i BETWEEN 1 AND 6 THEN (lead(u) OVER r - lag(u) OVER r) / 2 WHEN i = 0 THEN lead(u) OVER r - u ELSE u - lag(u) OVER r END + CASE WHEN j BETWEEN 1 AND 6 THEN (lead(v) OVER c - lag(v) OVER c) / 2 WHEN j = 0 THEN lead(v) OVER c - v ELSE v - lag(v) OVER c END AS x FROM F WINDOW r AS (PARTITION BY frame, j ORDER BY i), c AS (PARTITION BY frame, i ORDER BY j)) SELECT frame, i::INT AS i, j::INT AS j, round(x, 5) AS divergence FROM G")
def flow_divergence(spark, d):
    return traces.flow_divergence(_flow(spark, d), ["frame"]).select("frame", "i", "j", F.round("divergence", 5).alias("divergence"))


@query("focus_of_expansion", f"WITH {_FLOW}, B AS (SELECT frame, sum(v * v) AS vv, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * (j * v - i * u)) AS vb, sum(u * (j * v - i * u)) AS ub FROM F GROUP BY frame) SELECT frame, round((vb * uu - ub * uv) / (vv * uu - uv * uv), 4) AS foe_x, round((vb * uv - ub * vv) / (vv * uu - uv * uv), 4) AS foe_y FROM B")
def focus_of_expansion(spark, d):
    f = traces.focus_of_expansion(_flow(spark, d), ["frame"], x="j", y="i")
    return f.select("frame", F.round("foe_x", 4).alias("foe_x"), F.round("foe_y", 4).alias("foe_y"))


def _trace(spark, d) -> DataFrame:
    """Samples at 100 per second: place in the series for time."""
    s = samples(spark, d).select("series", "pos", (F.col("pos") / 100.0).alias("t"), "x", "y")
    return s


@query("trace_preprocessing")
def trace_preprocessing(spark, d):
    p = traces.TraceParams(rate=100.0, smooth=0.05, most_speed=6000.0, most_acceleration=3e5, rescue=0.01, widen=0.01, median=0.05)
    t = traces.preprocess(_trace(spark, d), "x", "y", p)
    return t.select("series", "pos", *(F.round(c, 4).alias(c) for c in ("x", "y", "vel", "acc", "medvel")), "blink")


@query("velocity_gain")
def velocity_gain(spark, d):
    s = samples(spark, d).select("series", "pos", (F.col("pos") * 0.02).alias("t"), F.col("v").alias("eye"), F.col("k").cast("double").alias("head"))
    g = traces.velocity_gain(s, "eye", "head", sigma=0.05, cutoff=2000.0)
    return g.select("series", "pos", F.round("gain", 4).alias("gain"), F.round("smooth_gain", 4).alias("smooth_gain"))


@query("event_clusters")
def event_clusters(spark, d):
    e = _events(spark, d).select("series", "label", "stsec", "dursec", "pvel", "avgvel")
    out, _ = detect.event_clusters(e, ["dursec", "pvel", "avgvel"])
    return out.select("series", "label", "stsec", "cluster")


@query("separate_eyes_regex", f"WITH {D} SELECT event_id, 'left' AS eye, x AS gx, v AS pa FROM D UNION ALL SELECT event_id, 'right', y, NULL FROM D")
def separate_eyes_regex(spark, d):
    s = samples(spark, d).select("event_id", F.col("x").alias("gx_left"), F.col("y").alias("gx_right"), F.col("v").alias("pa_left"))
    return cleaning.separate_eyes(s, ["_(left|right)$"]).select("event_id", "eye", "gx", "pa")


@query("session_info", f"WITH {D}, F AS (SELECT series, arg_min(k, (t, pos)) AS k, arg_max(lab, (t, pos)) AS lab FROM D GROUP BY series) SELECT series, k::VARCHAR AS width, lab AS kind, '500.0' AS rate, 'L' AS eyes, 'R' AS used FROM F")
def session_info(spark, d):
    """One message of each tag, made of a series' first k and last label."""
    f = samples(spark, d).groupBy("series").agg(F.min_by("k", F.struct("t", "pos")).alias("k"), F.max_by("lab", F.struct("t", "pos")).alias("lab"))
    text = [F.concat(F.lit("SCREEN W="), F.col("k").cast("string")), F.concat(F.lit("SESSION S KIND="), F.col("lab")), F.lit("RECCFG CR 500 2 1 L"), F.lit("GAZE_COORDS 0 0 1919 1079"), F.lit("EYE_USED 1 R"), F.lit("VB DM=0.57 PPM=3000")]
    m = f.select("series", F.posexplode(F.array(*text)).alias("p", "message")).withColumn("t", F.col("p").cast("double"))
    i = messages.session_info(messages.tagged(m), ["series"])
    at = lambda k: F.col("info")[k]
    return i.select("series", at("SCREEN_W").alias("width"), at("SESSION_KIND").alias("kind"), at("rate").alias("rate"), at("eyes").alias("eyes"), at("eye_mode").alias("used"))


def _new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/gazeflow/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT n_nationkey AS key, n_name AS name, round(n_nationkey / 7.0, 6) AS x FROM nation")
def csv_round_trip(spark, d):
    """An artefact written as CSV and scanned with a declared schema."""
    path = _new_path(spark, "csv")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), r6(F.col("n_nationkey") / 7.0).alias("x"))
    files.write_artefacts({"nation": n}, path, kind="csv")
    return files.read_delimited(spark, f"{path}/nation", "key int, name string, x double")


@query("tsv_scan", "SELECT r_regionkey AS key, r_name AS name, CASE WHEN r_regionkey > 1 THEN r_regionkey / 2.0 END AS x FROM region")
def tsv_scan(spark, d):
    """Tab-separated lines with leading blanks and NaN for what is missing."""
    path = _new_path(spark, "tsv")
    r = table(spark, d, "region").select(F.concat_ws("\t", F.concat(F.lit("  "), F.col("r_regionkey").cast("string")), F.concat(F.lit(" "), F.col("r_name")), F.when(F.col("r_regionkey") > 1, (F.col("r_regionkey") / 2.0).cast("string")).otherwise("NaN")).alias("value"))
    spark.createDataFrame([("key\tname\tx",)], "value string").unionAll(r).coalesce(1).write.text(path)
    return files.read_delimited(spark, path, "key int, name string, x double", sep="\t", trim=True)


@query("gzip_json_scan", "SELECT event_id, round(value, 6) AS gaze2d_0, round(value * 2, 6) AS gaze2d_1, CASE WHEN value < 100 THEN round(value / 10, 6) END AS pupil FROM events")
def gzip_json_scan(spark, d):
    """Wearable gaze lines, gzipped, read with their declared schema and flattened."""
    path = _new_path(spark, "gz")
    e = table(spark, d, "events")
    data = F.struct(F.array("value", F.col("value") * 2).alias("gaze2d"), F.when(F.col("value") < 100, F.struct((F.col("value") / 10).alias("pupildiameter"))).alias("eyeleft"))
    e.select(F.col("event_id").cast("double").alias("timestamp"), F.lit("gaze").alias("type"), data.alias("data")).write.option("compression", "gzip").json(path)
    g = files.flat_vectors(files.read_json_lines(spark, path, files.GAZE_SCHEMA))
    return g.select(F.col("timestamp").cast("long").alias("event_id"), r6("gaze2d_0").alias("gaze2d_0"), r6("gaze2d_1").alias("gaze2d_1"), r6("eyeleft_pupildiameter").alias("pupil"))


@query("key_value_scan", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 50 = 1")
def key_value_scan(spark, d):
    """Headers of `name, value` and `name: value` lines, a file each."""
    path = _new_path(spark, "kv")
    c = table(spark, d, "customer").where("c_custkey % 50 = 1")
    line = F.concat(F.lit("Program 1.0\nid: "), F.col("c_custkey").cast("string"), F.lit("\nname, "), F.col("c_name"), F.lit("\nsegment: none\nsegment: "), F.col("c_mktsegment"))
    c.select("c_custkey", line.alias("value")).repartition("c_custkey").write.partitionBy("c_custkey").text(path)
    kv = files.read_key_values(spark, f"{path}/*/*.txt").select("kv")
    return kv.select(*(F.col("kv")[n].alias(n) for n in ("id", "name", "segment")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("intersect_except", "SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'left' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def intersect_except(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionAll(c.subtract(s).withColumn("side", F.lit("left")))


@query("map_entries", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def map_entries(spark, d):
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.where("value IS NOT NULL")
