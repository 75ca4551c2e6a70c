"""Interval algebra: complements, merges, pairing and range joins of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def complement(events: DataFrame, keys: list[str], zero: float = 0.0, label: str = "ISI") -> DataFrame:
    """The gaps before events of a series, in the order of their starts: from the end of the event before (first: zero) to the own start. Other
    columns come from the event that ends the gap. Overlapping events give negative gaps. One event: none. No gap follows the last."""
    w = W.partitionBy(*keys).orderBy("stsec", "ensec")
    out = events.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("_st", F.coalesce(F.lag("ensec").over(w), F.lit(float(zero))))
    out = out.where("_n > 1").withColumn("ensec", F.col("stsec")).withColumn("stsec", F.col("_st")).withColumn("dursec", F.col("ensec") - F.col("stsec"))
    return out.withColumn("label", F.lit(label)).drop("_n", "_st")


def overlap_groups(events: DataFrame, keys: list[str], *, gap: float = 0.0, touching: bool = True, start: str = "stsec", end: str = "ensec", name: str = "grp") -> DataFrame:
    """Adds a number per group of events that chain together: the start is at most gap after the largest end before (touching), or below it."""
    w = W.partitionBy(*keys).orderBy(start, end)
    most = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)) + F.lit(float(gap))
    new = F.coalesce(F.col(start) > most if touching else F.col(start) >= most, F.lit(True))
    return events.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_envelope(events: DataFrame, keys: list[str], margin: float, widen: Column) -> DataFrame:
    """Where widen holds, events grow by margin to both sides; those that then touch become one: least start, largest end, peak of pvel,
    mean of avgvel, n. A merged event is a BLNK, a single one is as it was."""
    e = events.withColumn("_a", F.when(widen, F.col("stsec") - margin).otherwise(F.col("stsec"))).withColumn("_b", F.when(widen, F.col("ensec") + margin).otherwise(F.col("ensec")))
    e = overlap_groups(e, keys, start="_a", end="_b")
    g = e.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"), F.min("stsec").alias("st1"), F.max("ensec").alias("en1"), F.min("_a").alias("st2"), F.max("_b").alias("en2"), F.min_by("label", "_a").alias("label1"), F.max("pvel").alias("pvel"), F.avg("avgvel").alias("avgvel"))
    many = F.col("n") > 1
    return g.select(*keys, F.when(many, F.col("st2")).otherwise(F.col("st1")).alias("stsec"), F.when(many, F.col("en2")).otherwise(F.col("en1")).alias("ensec"), F.when(many, "BLNK").otherwise(F.col("label1")).alias("label"), "pvel", "avgvel", "n")


def merge_union(events: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Events at most gap apart become one: start, end, largest pvel, n."""
    e = overlap_groups(events, keys, gap=gap)
    return e.groupBy(*keys, "grp").agg(F.min("stsec").alias("stsec"), F.max("ensec").alias("ensec"), F.max("pvel").alias("pvel"), F.count(F.lit(1)).alias("n")).drop("grp")


def merge_saccades(events: DataFrame, keys: list[str], gap: float, *, starts: tuple[str, ...] = ("stx", "sty"), ends: tuple[str, ...] = ("enx", "eny")) -> DataFrame:
    """Events whose label starts with SACC, at most gap apart, become one: start, end and end points of the first and last, ampldva, largest pvel, label
    SACCBLNK if one of them is, else SACC. Single ones and other events stay as they are. Order: stsec, ensec, label."""
    is_sacc = F.coalesce(F.upper("label").startswith("SACC"), F.lit(False))
    e = overlap_groups(events.withColumn("_s", is_sacc), [*keys, "_s"], gap=gap)
    e = e.withColumn("grp", F.when(F.col("_s"), F.col("grp")).otherwise(-F.monotonically_increasing_id() - 1))
    order, many = F.struct("stsec", "ensec", "label"), F.count(F.lit(1)) > 1
    g = e.groupBy(*keys, "grp").agg(
        F.when(many, F.when(F.max(F.upper("label") == "SACCBLNK"), "SACCBLNK").otherwise("SACC")).otherwise(F.first("label")).alias("label"), F.min("stsec").alias("stsec"), F.max("ensec").alias("ensec"),
        *(F.min_by(c, order).alias(c) for c in starts), *(F.max_by(c, order).alias(c) for c in ends), F.max("pvel").alias("pvel"), F.count(F.lit(1)).alias("n"),
    )
    far = F.sqrt(sum(((F.col(b) - F.col(a)) ** 2 for a, b in zip(starts, ends, strict=True)), F.lit(0.0)))
    return g.drop("grp").withColumn("dursec", F.col("ensec") - F.col("stsec")).withColumn("ampldva", far)


def intersect_groups(events: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of overlapping events whose common part isn't empty: that part, largest pvel, mean avgvel, n. Others are left to
    intersect_recursive()."""
    e = overlap_groups(events, keys, touching=False)
    g = e.groupBy(*keys, "grp").agg(F.max("stsec").alias("stsec"), F.min("ensec").alias("ensec"), F.max("pvel").alias("pvel"), F.avg("avgvel").alias("avgvel"), F.count(F.lit(1)).alias("n"))
    return g.where("stsec < ensec").drop("grp")


def intersect_recursive(events: DataFrame, keys: list[str]) -> DataFrame:
    """As intersect_groups(); in groups without a common part the longest event goes and the rest is grouped again, until all groups have one.
    A group of overlapping events is one task's unit; groups are small, since they end where a series is quiet."""
    e = overlap_groups(events, keys, touching=False).select(*keys, "grp", "stsec", "ensec", "pvel", "avgvel")

    def solve(pdf):
        import pandas as pd

        out = []

        def work(rows):
            rows = sorted(rows)
            groups, most = [], None
            for r in rows:
                if most is None or r[0] >= most:
                    groups.append([])
                    most = r[1]
                groups[-1].append(r)
                most = max(most, r[1])
            for g in groups:
                a, b = max(r[0] for r in g), min(r[1] for r in g)
                if a < b or len(g) == 1:
                    out.append((a, b, max(r[2] for r in g), sum(r[3] for r in g) / len(g), len(g)))
                else:
                    longest = max(range(len(g)), key=lambda i: (g[i][1] - g[i][0], -i))
                    work(g[:longest] + g[longest + 1 :])

        work(list(zip(pdf["stsec"], pdf["ensec"], pdf["pvel"], pdf["avgvel"], strict=True)))
        res = pd.DataFrame(out, columns=["stsec", "ensec", "pvel", "avgvel", "n"])
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    kinds = dict(events.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["stsec double, ensec double, pvel double, avgvel double, n long"])
    return e.groupBy(*keys, "grp").applyInPandas(solve, schema)


def bridge_merge(events: DataFrame, keys: list[str], max_isi: float) -> DataFrame:
    """ISIs shorter than max_isi glue their neighbours and themselves together. Label of a group: SACCBLNK if it holds SACC and BLNK, else
    BLNK, SACC, another one, ISI."""
    w = W.partitionBy(*keys).orderBy("stsec", "ensec")
    glue = (F.col("label") == "ISI") & (F.col("dursec") < max_isi)
    e = events.withColumn("_glue", glue).withColumn("_join", glue | F.coalesce(F.lag(glue).over(w), F.lit(False)))
    e = e.withColumn("_new", (~F.col("_join") | (F.row_number().over(w) == 1)).cast("int")).withColumn("grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    has = lambda x: F.max(F.col("label") == x)
    label = F.when(has("SACC") & has("BLNK"), "SACCBLNK").when(has("BLNK"), "BLNK").when(has("SACC"), "SACC").otherwise(F.coalesce(F.min(F.when(F.col("label") != "ISI", F.col("label"))), F.lit("ISI")))
    return e.groupBy(*keys, "grp").agg(F.min("stsec").alias("stsec"), F.max("ensec").alias("ensec"), label.alias("label"), F.count(F.lit(1)).alias("n")).drop("grp")


def bridge_merge_chained(events: DataFrame, keys: list[str], *, max_isi: float, min_blink: float, max_amplitude: float) -> DataFrame:
    """Blinks shorter than min_blink and smaller than max_amplitude count as ISIs. ISIs shorter than max_isi are bridges; bridges and their neighbours on
    both sides are marked, and marked events in a row become one: start, end, end points, dxdva, dydva, ampldva, angle, largest pvel, mean
    avgvel, n, and the label as in bridge_merge(). Order: stsec, ensec."""
    w = W.partitionBy(*keys).orderBy("stsec", "ensec")
    noise = (F.upper("label") == "BLNK") & (F.col("dursec") < min_blink) & (F.col("ampldva") < max_amplitude)
    e = events.withColumn("label", F.when(F.coalesce(noise, F.lit(False)), "ISI").otherwise(F.upper("label")))
    bridge = (F.col("label") == "ISI") & (F.col("dursec") < max_isi)
    e = e.withColumn("_b", F.coalesce(bridge, F.lit(False)))
    e = e.withColumn("_m", F.col("_b") | F.coalesce(F.lag("_b").over(w), F.lit(False)) | F.coalesce(F.lead("_b").over(w), F.lit(False)))
    e = e.withColumn("_new", (~(F.col("_m") & F.coalesce(F.lag("_m").over(w), F.lit(False)))).cast("int"))
    e = e.withColumn("grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    has = lambda x: F.max(F.col("label") == x)
    label = F.when(has("SACC") & has("BLNK"), "SACCBLNK").when(has("BLNK"), "BLNK").when(has("SACC"), "SACC").otherwise(F.coalesce(F.min(F.when(F.col("label") != "ISI", F.col("label"))), F.lit("ISI")))
    order = F.struct("stsec", "ensec")
    g = e.groupBy(*keys, "grp").agg(
        F.min("stsec").alias("stsec"), F.max("ensec").alias("ensec"), *(F.min_by(c, order).alias(c) for c in ("stx", "sty")), *(F.max_by(c, order).alias(c) for c in ("enx", "eny")),
        F.max("pvel").alias("pvel"), F.avg("avgvel").alias("avgvel"), label.alias("label"), F.count(F.lit(1)).alias("n"),
    )
    g = g.drop("grp").withColumn("dxdva", F.col("enx") - F.col("stx")).withColumn("dydva", F.col("eny") - F.col("sty"))
    return g.withColumn("ampldva", F.sqrt(F.col("dxdva") ** 2 + F.col("dydva") ** 2)).withColumn("angle", F.degrees(F.atan2("dydva", "dxdva"))).withColumn("dursec", F.col("ensec") - F.col("stsec"))


def pair_markers(markers: DataFrame, keys: list[str], *, time: str = "t", tiebreak: str = "pos") -> DataFrame:
    """markers: mark in S, E, A. Of successive starts (or ends) the first counts; a start without an end goes; the i-th start has the i-th end;
    pairs that end in A are aborted and go."""
    w = W.partitionBy(*keys).orderBy(time, tiebreak)
    kind = F.when(F.col("mark") == "S", "S").otherwise("E")
    m = markers.withColumn("_k", kind).withColumn("_p", F.lag(kind).over(w)).where("_p IS NULL OR _p <> _k").where("NOT (_p IS NULL AND _k = 'E')")
    nxt = W.partitionBy(*keys).orderBy(time, tiebreak)
    m = m.withColumn("ensec", F.lead(time).over(nxt)).withColumn("_end", F.lead("mark").over(nxt))
    return m.where("_k = 'S' AND _end IS NOT NULL AND _end <> 'A'").select(*keys, F.col(time).alias("stsec"), "ensec")


def range_flags(samples: DataFrame, events: DataFrame, keys: list[str], width: float, *, closed: bool = True) -> DataFrame:
    """samples, each row one of its own, with n_events and last_label of the events that hold their time. Events are dealt to time buckets of width, so the join is an
    equi-join on (keys, bucket), however long a series is; the predicate is checked again inside."""
    b = F.explode(F.sequence(F.floor(F.col("stsec") / width), F.floor(F.col("ensec") / width))).alias("_b")
    e = events.select(*(F.col(k).alias(f"_{k}") for k in keys), "stsec", "ensec", "label", b)
    s = samples.withColumn("_sb", F.floor(F.col("t") / width)).withColumn("_row", F.monotonically_increasing_id())
    on = F.col("_sb") == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    on = on & (F.col("t") >= F.col("stsec")) & (F.col("t") <= F.col("ensec") if closed else F.col("t") < F.col("ensec"))
    joined = s.join(e, on, "left")
    rows = joined.groupBy("_row", *samples.columns).agg(F.count("stsec").alias("n_events"), F.max_by("label", F.struct("stsec", "ensec")).alias("last_label"))
    return rows.drop("_row")


def overlap_clip(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of overlapping intervals (l_st, l_en) and (r_st, r_en) with their common part st, en. Both sides are dealt to time
    buckets; a pair counts in the bucket where its common part starts."""
    lb = F.explode(F.sequence(F.floor(F.col("l_st") / width), F.floor(F.col("l_en") / width))).alias("_b")
    rb = F.explode(F.sequence(F.floor(F.col("r_st") / width), F.floor(F.col("r_en") / width))).alias("_b")
    both = left.select("*", lb).join(right.select("*", rb), [*keys, "_b"])
    both = both.where((F.col("l_st") < F.col("r_en")) & (F.col("l_en") > F.col("r_st"))).withColumn("st", F.greatest("l_st", "r_st")).withColumn("en", F.least("l_en", "r_en"))
    return both.where(F.floor(F.col("st") / width) == F.col("_b")).drop("_b")


def within_periods(events: DataFrame, periods: DataFrame, keys: list[str], width: float) -> DataFrame:
    """events with the columns of each stated period (keys, p_st, p_en and others) that holds them whole: p_st <= stsec and ensec <= p_en. Periods
    are dealt to time buckets, an event looks in that of its start: an equi-join on (keys, bucket)."""
    b = F.explode(F.sequence(F.floor(F.col("p_st") / width), F.floor(F.col("p_en") / width))).alias("_b")
    both = events.withColumn("_b", F.floor(F.col("stsec") / width)).join(periods.select("*", b), [*keys, "_b"])
    return both.where((F.col("p_st") <= F.col("stsec")) & (F.col("ensec") <= F.col("p_en"))).drop("_b")
