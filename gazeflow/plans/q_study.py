"""Queries: joins, study statistics, scalar functions, windows of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gazeflow.functions import scalar as fn
from gazeflow.operators import cleaning, graph, study
from gazeflow.streaming import windows

from .common import D, r6, rounded, samples, table
from .q_events import _EV, _events

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("outer_merge_sensors", "WITH O AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), C AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 0) SELECT k, n, bal FROM O FULL JOIN C USING (k)")
def outer_merge_sensors(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return o.join(c, "k", "full_outer")


@query("semi_anti_isin", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS has_big, c_mktsegment IN ('BUILDING', 'MACHINERY') AS in_list FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")
def semi_anti_isin(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    on = F.col("c_custkey") == F.col("o_custkey")
    out = lambda df, has: df.select("c_custkey", F.lit(has).alias("has_big"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("in_list"))
    return out(c.join(big, on, "left_semi"), True).unionByName(out(c.join(big, on, "left_anti"), False))


@query("lookup_fallback", "SELECT s_suppkey, coalesce(n.n_name, r.r_name, 'unknown') AS place FROM supplier LEFT JOIN nation n ON s_nationkey = n.n_nationkey AND n.n_regionkey < 3 LEFT JOIN region r ON s_nationkey % 7 = r.r_regionkey")
def lookup_fallback(spark, d):
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("s_nationkey") % 7 == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("place"))


_REG = _EV + ", P AS (SELECT *, floor(stsec / 604800)::BIGINT AS week FROM E), Q AS (SELECT * FROM P WHERE ensec <= (week + 1) * 604800)"
_REGS = " SELECT series, week, count(*) AS n, round(sum(dursec), 6) AS total, round(median(pvel), 4) AS med_size, round(stddev_samp(pvel), 4) AS sd_size, count(*) FILTER (WHERE pvel < 50) AS n_small, count(*) FILTER (WHERE pvel > 50) AS n_big, round(count(*) / 604800.0 * 1000000, 4) AS rate, round(count(*) FILTER (WHERE pvel > 50) / nullif(count(*) FILTER (WHERE pvel < 50), 0)::DOUBLE, 6) AS big_small FROM Q GROUP BY series, week"


def _regressors(spark, d):
    e = _events(spark, d).withColumn("week", F.floor(F.col("stsec") / 604800)).where(F.col("ensec") <= (F.col("week") + 1) * 604800)
    g = study.regressors(e, ["series", "week"], "dursec", "pvel", 50.0, F.lit(604800.0)).drop("span")
    g = g.withColumn("rate", F.round(F.col("rate") * 1000000, 4)).withColumn("med_size", F.round("med_size", 4)).withColumn("sd_size", F.round("sd_size", 4))
    return rounded(g, "total", "big_small")


@query("period_regressors", _REG + _REGS)
def period_regressors(spark, d):
    return _regressors(spark, d)


@query("melt_regressors", _REG + ", R AS (" + _REGS + ") SELECT series, week, unnest(['n', 'n_small', 'n_big']) AS variable, unnest([n, n_small, n_big]) AS value FROM R")
def melt_regressors(spark, d):
    return _regressors(spark, d).unpivot(["series", "week"], ["n", "n_small", "n_big"], "variable", "value")


@query("trial_quality", f"WITH {D} SELECT series, count(*) AS n, count(x) AS good, round(100.0 * count(x) / count(*), 6) AS pct, count(*) FILTER (WHERE x > 50) AS n_over FROM D GROUP BY series")
def trial_quality(spark, d):
    return rounded(samples(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("good"), (100.0 * F.count("x") / F.count(F.lit(1))).alias("pct"), F.count_if(F.col("x") > 50).alias("n_over")), "pct")


@query("group_size", f"WITH {D} SELECT event_id, count(*) OVER (PARTITION BY series, lab) AS n FROM D")
def group_size(spark, d):
    return samples(spark, d).select("event_id", F.count(F.lit(1)).over(Window.partitionBy("series", "lab")).alias("n"))


@query("typed_summary", f"WITH {D}, L AS (SELECT series, lab, min(pos) AS p FROM D GROUP BY ALL), T AS (SELECT series, string_agg(lab, ';' ORDER BY p) AS lab FROM L GROUP BY series) SELECT series, round(avg(v), 6) AS v, any_value(T.lab) AS lab FROM D JOIN T USING (series) GROUP BY series")
def typed_summary(spark, d):
    return rounded(study.typed_summary(samples(spark, d), ["series"], "pos", ["v"], ["lab"]), "v")


_DAY = f"WITH {D}, Y AS (SELECT series, series % 10 AS grp, floor(t / 86400)::BIGINT AS day, avg(v) AS a, avg(k) AS b FROM D GROUP BY ALL), P AS (SELECT p.grp, p.day, p.series AS series1, q.series AS series2, p.a AS a1, q.a AS a2, p.b AS b1, q.b AS b2 FROM Y p JOIN Y q ON p.grp = q.grp AND p.day = q.day AND p.series > q.series)"


def _pairs(spark, d):
    y = samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("grp", F.col("series") % 10).groupBy("series", "grp", "day").agg(F.avg("v").alias("a"), F.avg("k").alias("b"))
    return study.pairs(y, ["grp"], "series", "day", ["a", "b"])


_ALL = f"WITH {D}, Y AS (SELECT series, floor(t / 86400)::BIGINT AS day, avg(v) AS a, avg(k) AS b FROM D GROUP BY ALL), P AS (SELECT p.day, p.series AS series1, q.series AS series2, p.a AS a1, q.a AS a2, p.b AS b1, q.b AS b2 FROM Y p JOIN Y q ON p.day = q.day AND p.series > q.series)"


def _daily(spark, d):
    return samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).groupBy("series", "day").agg(F.avg("v").alias("a"), F.avg("k").alias("b"))


@query("pairwise_corr", _ALL + " SELECT series1, series2, count(*) AS n, round(corr(a1, a2), 4) AS ra, round(corr(b1, b2), 4) AS rb FROM P GROUP BY ALL HAVING count(*) >= 5")
def pairwise_corr(spark, d):
    return study.correlations(_daily(spark, d), "series", "day", {"a": "ra", "b": "rb"}, 5, 4)


@query("pairwise_distance", _ALL + " SELECT series1, series2, day, round(sqrt(pow(a1 - a2, 2) + pow(b1 - b2, 2)), 4) AS dist FROM P")
def pairwise_distance(spark, d):
    return study.distances(_daily(spark, d), "series", "day", ["a", "b"], "dist", 4)


@query("pair_heatmap_pivot", _DAY + ", SS AS (SELECT least(series1, series2) % 5 AS a, greatest(series1, series2) % 5 AS b, sqrt(pow(a1 - a2, 2)) AS dist FROM P) SELECT a, round(avg(dist) FILTER (WHERE b = 0) + 1e-9, 4) AS c0, round(avg(dist) FILTER (WHERE b = 1) + 1e-9, 4) AS c1, round(avg(dist) FILTER (WHERE b = 2) + 1e-9, 4) AS c2, round(avg(dist) FILTER (WHERE b = 3) + 1e-9, 4) AS c3, round(avg(dist) FILTER (WHERE b = 4) + 1e-9, 4) AS c4 FROM SS GROUP BY a")
def pair_heatmap_pivot(spark, d):
    p = _pairs(spark, d).select((F.least("series1", "series2") % 5).alias("a"), (F.greatest("series1", "series2") % 5).alias("b"), F.abs(F.col("a1") - F.col("a2")).alias("dist"))
    p = p.groupBy("a").pivot("b", [0, 1, 2, 3, 4]).agg(F.round(F.avg("dist") + 1e-9, 4))
    return p.select("a", *(F.col(str(i)).alias(f"c{i}") for i in range(5)))


_HIST = "WITH I AS (SELECT l_returnflag || l_linestatus AS grp, l_returnflag AS flag, least(floor(l_extendedprice / 2000), 49)::INT AS bin FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000), N AS (SELECT grp, flag, count(*) AS n FROM I GROUP BY ALL), G AS (SELECT grp, flag, n, unnest(range(0, 50))::INT AS bin FROM N), C AS (SELECT grp, bin, count(*) AS c FROM I GROUP BY ALL), H AS (SELECT G.flag, G.bin, coalesce(c, 0) / (n * 2000.0) AS density FROM G LEFT JOIN C USING (grp, bin)) "


@query("hist_density_mean_sd", _HIST + "SELECT bin, round(avg(density) * 1e6, 4) AS mean, round(stddev_pop(density) * 1e6, 4) AS sd, count(*) AS groups FROM H GROUP BY bin")
def hist_density_mean_sd(spark, d):
    li = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_extendedprice")
    h = study.density(li, ["grp"], "l_extendedprice", 0.0, 100000.0, 50)
    return h.groupBy("bin").agg(F.round(F.avg("density") * 1e6, 4).alias("mean"), F.round(F.stddev_pop("density") * 1e6, 4).alias("sd"), F.count(F.lit(1)).alias("groups"))


@query("ecdf_grid", "WITH G AS (SELECT unnest(range(0, 51))::INT AS point), F AS (SELECT DISTINCT l_returnflag FROM lineitem) SELECT l_returnflag, point, round((SELECT count(*) FILTER (WHERE l_quantity <= point * 1.0) / count(*)::DOUBLE FROM lineitem l WHERE l.l_returnflag = F.l_returnflag), 6) AS share FROM F, G")
def ecdf_grid(spark, d):
    return rounded(study.ecdf(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 51), "share")


@query("joint_hist_marginals", "SELECT floor(l_quantity / 10)::INT AS q, floor(l_discount * 50)::INT AS disc, round(sum(l_extendedprice), 2) AS w, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((floor(l_quantity / 10)::INT, floor(l_discount * 50)::INT), (floor(l_quantity / 10)::INT), (floor(l_discount * 50)::INT))")
def joint_hist_marginals(spark, d):
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("q"), F.floor(F.col("l_discount") * 50).cast("int").alias("disc"), "l_extendedprice")
    both = [F.col("q"), F.col("disc")]
    return li.groupingSets([both, both[:1], both[1:]], "q", "disc").agg(F.round(F.sum("l_extendedprice"), 2).alias("w"), F.count(F.lit(1)).alias("n"))


@query("age_bins", "SELECT o_orderkey, CASE WHEN m < 12 THEN 'young' WHEN m < 36 THEN 'middle' ELSE 'old' END AS age, round(m, 6) AS months FROM (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 30.0 AS m FROM orders)")
def age_bins(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1995-01-01"))) / 30.0)
    return o.select("o_orderkey", F.when(F.col("m") < 12, "young").when(F.col("m") < 36, "middle").otherwise("old").alias("age"), r6("m").alias("months"))


@query("midrank_percentile", "SELECT c_custkey, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) - 1 + count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS pct FROM customer")
def midrank_percentile(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(study.midrank(None, "c_nationkey", ["c_mktsegment"])).alias("pct"))


@query("info_gain", "WITH C AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), T AS (SELECT *, n / sum(n) OVER (PARTITION BY p) AS a, sum(n) OVER (PARTITION BY s) / sum(n) OVER () AS b FROM C) SELECT p, s, round(log2(a) - log2(b), 6) AS gain FROM T")
def info_gain(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("p"))
    rest = F.sum("n").over(Window.partitionBy("s")) / F.sum("n").over(Window.partitionBy())
    return c.select("p", "s", r6(fn.info_gain(share, rest)).alias("gain"))


_EMB = "WITH X AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), U AS (SELECT vec_id, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM X) "


def _unit(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abc")))
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return e.select("vec_id", *((F.col(n) / norm).alias(m) for n, m in zip("abc", "xyz", strict=True)))


@query("axis_mean_std", "WITH X AS (SELECT label, unnest(range(0, len(embedding))) AS i, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings), G AS (SELECT label, sum(w) AS w, sum(w * i) AS wi, sum(w * i * i) AS wii, count(*) FILTER (WHERE w <> 0) AS n FROM X GROUP BY label) SELECT label, round(wi / w, 4) AS mean, round(sqrt(greatest((wii / w - pow(wi / w, 2)) * n / (n - 1.0), 0)), 4) AS sd FROM G")
def axis_mean_std(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "w")).withColumn("w", F.abs(F.col("w").cast("double")))
    m = study.axis_mean_sd(e, ["label"], "i", "w")
    return m.select("label", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("vector_ypr", _EMB + "SELECT vec_id, round(degrees(atan2(y, x)), 4) AS yaw, round(degrees(asin(-z)), 4) AS pitch, round(degrees(atan2(-y * z / (1 + x), 1 - z * z / (1 + x))), 4) AS roll FROM U")
def vector_ypr(spark, d):
    yaw, pitch, roll = fn.yaw_pitch_roll(F.col("x"), F.col("y"), F.col("z"))
    return _unit(spark, d).select("vec_id", F.round(yaw, 4).alias("yaw"), F.round(pitch, 4).alias("pitch"), F.round(roll, 4).alias("roll"))


@query("lat_lon", _EMB + "SELECT vec_id, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon FROM U")
def lat_lon(spark, d):
    lat, lon = fn.lat_lon(F.col("x"), F.col("y"), F.col("z"))
    return _unit(spark, d).select("vec_id", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


@query("axis_permute", "SELECT vec_id, embedding[3]::DOUBLE AS n, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS u FROM embeddings")
def axis_permute(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", fn.permuted(F.col("embedding")).alias("p"))
    return e.select("vec_id", *(F.col("p")[i].cast("double").alias(n) for i, n in enumerate("nwu")))


@query("screen_angles", "SELECT p_partkey, round(degrees(2 * atan(p_size / 100.0 / 2 / 0.57)), 6) AS dva, round(0.57 * tan(radians(p_size)), 6) AS m, round(0.57 / cos(radians(p_size)), 6) AS dist, round(atan2(p_size / 100.0, 0.57), 6) AS rad, round(CASE WHEN degrees(atan2(0.01, p_size / 50.0)) <= 2 THEN degrees(atan2(0.01, p_size / 50.0)) / 0.01 END, 4) AS per_m FROM part")
def screen_angles(spark, d):
    size, dist = F.col("p_size"), F.lit(0.57)
    return table(spark, d, "part").select("p_partkey", r6(fn.flatscreen_dva(dist, size / 100.0)).alias("dva"), r6(fn.deg_from_mid_to_meter(dist, size)).alias("m"), r6(fn.dist_at_angle_deg(dist, size)).alias("dist"), r6(fn.meter_to_rad(dist, size / 100.0)).alias("rad"), F.round(fn.center_dva_per_meter(size / 50.0), 4).alias("per_m"))


@query("main_sequence_filter", _EV + " SELECT series, label, round(stsec, 6) AS stsec FROM E WHERE dursec / 1e6 BETWEEN 0.014 + pvel / 20 * (0.060 - 0.014) / 16 AND 0.045 + pvel / 20 * (0.170 - 0.045) / 16")
def main_sequence_filter(spark, d):
    e = _events(spark, d)
    return e.where(fn.main_sequence(F.col("pvel") / 20, F.col("dursec") / 1e6)).select("series", "label", r6("stsec").alias("stsec"))


@query("json_props_flatten", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, props IS NOT NULL AS has_props FROM events")
def json_props_flatten(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("props").isNotNull().alias("has_props"))


@query("tag_kv_parse", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref, split_part(url, '?', 1) AS tag FROM pages")
def tag_kv_parse(spark, d):
    p = table(spark, d, "pages")
    body = F.when(F.instr("url", "?") > 0, F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", " ")).otherwise("")
    p = p.withColumn("m", fn.tag_map(body))
    return p.select("page_id", F.nullif(F.col("m")["page"], F.lit("")).alias("page"), F.nullif(F.col("m")["ref"], F.lit("")).alias("ref"), F.substring_index("url", "?", 1).alias("tag"))


@query("regex_header_extract", "SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS num FROM pages")
def regex_header_extract(spark, d):
    x = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", x("^(https?)").alias("scheme"), x("//([^/]+)/").alias("host"), x("/([a-z][a-z])/").alias("lang"), x("/([0-9]+)").try_cast("long").alias("num"))


@query("file_kinds", "SELECT page_id, lower(split_part(split_part(url, '?', 1), '.', -1)) IN ('html', 'htm') AS is_page FROM pages")
def file_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", fn.is_video(F.substring_index("url", "?", 1), ("html", "htm")).alias("is_page"))


@query("null_model_hash_shuffle")
def null_model_hash_shuffle(spark, d):
    return study.shuffled(samples(spark, d), ["series"], 7, "v", ["t", "pos"]).select("series", "event_id", "v", "v_other")


@query("connected_components", "WITH RECURSIVE S AS (SELECT s_suppkey AS r, s_nationkey * 1000 + (s_acctbal / 500)::INT AS a, (s_suppkey / 3)::INT % 1000 * 100 + s_nationkey AS b FROM supplier), E AS (SELECT x.r AS p, y.r AS q FROM S x JOIN S y ON x.a = y.a OR x.b = y.b), C(r, m) AS (SELECT r, r FROM S UNION SELECT E.q, C.m FROM C JOIN E ON C.r = E.p) SELECT r AS s_suppkey, min(m) AS cluster FROM C GROUP BY r")
def connected_components(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 1000 + F.expr("cast(bround(s_acctbal / 500, 0) AS int)")).alias("a"), (F.expr("cast(bround(s_suppkey / 3D, 0) AS int)") % 1000 * 100 + F.col("s_nationkey")).alias("b"))
    return graph.clusters(s, "s_suppkey", ["a", "b"])


@query("session_windows", f"WITH {D}, G AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series ORDER BY t, pos) < 21600 THEN 0 ELSE 1 END AS new FROM D), H AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS ses FROM G) SELECT series, count(*) AS n, round(sum(v), 4) AS total, round(min(t), 3) AS st FROM H GROUP BY series, ses")
def session_windows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    w = windows.sessions(e, "ts", ["series"], "6 hours", [F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total")])
    return w.select("series", "n", "total", F.round((F.unix_micros("start") - 1704067200000000) / 1e6, 3).alias("st"))


@query("tumbling_counts", "SELECT event_type, floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::BIGINT AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windows.tumbling(e, "ts", ["event_type"], "1 hour", [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return w.select("event_type", F.floor((F.unix_seconds("start") - 1704067200) / 3600).alias("hour"), "n", "total")


@query("union_missing_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def union_missing_columns(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return c.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("exclude_bad", f"WITH {D} SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE v END AS v FROM D")
def exclude_bad(spark, d):
    return cleaning.exclude_bad(samples(spark, d).withColumn("bad", F.col("k") % 5 == 0), ["v"]).select("event_id", "v")
