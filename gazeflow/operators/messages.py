"""Tracker messages: tags, sessions, trials and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeflow.functions.scalar import tag_map
from gazeflow.operators.timing import asof
from gazeflow.series import Axis


def tagged(messages: DataFrame) -> DataFrame:
    """Adds tag (the first token) and body (the rest) of column message."""
    m = F.trim("message")
    return messages.withColumn("tag", F.substring_index(m, " ", 1)).withColumn("body", F.when(F.instr(m, " ") > 0, F.substring(m, F.instr(m, " ") + 1, F.length(m))).otherwise(""))


def tag_lists(messages: DataFrame, tag: str) -> DataFrame:
    """t, tokens of a tag's messages."""
    return messages.where(F.col("tag") == tag).withColumn("tokens", F.filter(F.split("body", " "), lambda x: x != ""))


def tag_params(messages: DataFrame, tag: str, keys: list[str], *, first: str | None = None) -> DataFrame:
    """Per series: params, the KEY=VALUE tokens of a tag's messages as TAG_KEY; later messages win. first: only messages whose first token it is
    (which then isn't a parameter). A token with two `=` fails."""
    m = messages.where(F.col("tag") == tag)
    if first is not None:
        m = m.where(F.substring_index("body", " ", 1) == first).withColumn("body", F.substring(F.col("body"), len(first) + 2, F.length("body")))
    bad = F.exists(F.split("body", " "), lambda x: F.size(F.split(x, "=")) > 2)
    m = m.withColumn("body", F.when(bad, F.raise_error(F.concat(F.lit("two = in "), F.col("body")))).otherwise(F.col("body")))
    m = m.select(*keys, "t", F.explode(F.map_entries(tag_map(F.col("body")))).alias("e"))
    last = m.groupBy(*keys, F.concat(F.lit(f"{tag}_"), F.col("e.key")).alias("k")).agg(F.max_by("e.value", "t").alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("params"))


def recording_config(messages: DataFrame) -> DataFrame:
    """mode, rate, file_filter, link_filter, eyes of RECCFG messages."""
    x = tag_lists(messages, "RECCFG")
    return x.select(*[c for c in x.columns if c not in ("tokens", "tag", "body", "message")], F.get("tokens", F.lit(0)).alias("mode"), F.get("tokens", F.lit(1)).try_cast("double").alias("rate"), F.get("tokens", F.lit(2)).try_cast("int").alias("file_filter"), F.get("tokens", F.lit(3)).try_cast("int").alias("link_filter"), F.get("tokens", F.lit(4)).alias("eyes"))


def gaze_coords(messages: DataFrame) -> DataFrame:
    """left, top, right, bottom of GAZE_COORDS messages."""
    x = tag_lists(messages, "GAZE_COORDS")
    return x.select(*[c for c in x.columns if c not in ("tokens", "tag", "body", "message")], *(F.get("tokens", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))))


def eye_used(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: eye_index, eye_mode of the first EYE_USED message."""
    x = tag_lists(messages, "EYE_USED").groupBy(*keys).agg(F.min_by("tokens", "t").alias("tokens"))
    return x.select(*keys, F.get("tokens", F.lit(0)).alias("eye_index"), F.get("tokens", F.lit(1)).alias("eye_mode"))


def session_info(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: info, a map of the parameters of SCREEN, VB, SESSION S, RECCFG, GAZE_COORDS and EYE_USED messages. Two sources of one name fail."""
    texts = lambda names: F.map_filter(F.create_map(*(y for n in names for y in (F.lit(n), F.col(n).cast("string")))), lambda _, v: v.isNotNull())
    first = lambda df, names: df.groupBy(*keys).agg(*(F.min_by(n, "t").alias(n) for n in names)).select(*keys, texts(names).alias("params"))
    parts = [tag_params(messages, t, keys) for t in ("SCREEN", "VB")] + [tag_params(messages, "SESSION", keys, first="S")]
    parts += [first(recording_config(messages), ["mode", "rate", "file_filter", "link_filter", "eyes"]), first(gaze_coords(messages), ["left", "top", "right", "bottom"])]
    parts.append(eye_used(messages, keys).select(*keys, texts(["eye_index", "eye_mode"]).alias("params")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.select(*keys, F.explode(F.map_entries("params")).alias("e")).groupBy(*keys, F.col("e.key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first("e.value").alias("v"))
    value = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("overwritten: "), F.col("k")))).otherwise(F.col("v"))
    return one.select(*keys, "k", value.alias("v")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("info"))


def trials(messages: DataFrame, keys: list[str], *, keep_aborted: bool = False, tiebreak: tuple[str, ...] = ("pos", "message")) -> DataFrame:
    """Trials from VID messages `S name KEY=VALUE ...` and `E name` (or `A name`): start, end, video, params, is_abort, trial (from 0). Of successive
    starts the first counts, of successive ends the first; a last start without an end goes; a video that ends under another name
    fails; aborted trials go unless kept. Where times are equal, those of the tiebreak columns that
    there are give the order."""
    w = W.partitionBy(*keys).orderBy("t", *(c for c in tiebreak if c in messages.columns))
    m = tag_lists(messages, "VID").withColumn("kind", F.get("tokens", F.lit(0))).withColumn("video", F.get("tokens", F.lit(1)))
    m = m.withColumn("_k", F.when(F.col("kind") == "S", "S").otherwise("E")).withColumn("_p", F.lag("_k").over(w)).where("_p IS NULL OR _p <> _k").where("NOT (_p IS NULL AND _k = 'E')")
    m = m.withColumn("end", F.lead("t").over(w)).withColumn("_ek", F.lead("kind").over(w)).withColumn("_ev", F.lead("video").over(w)).where("_k = 'S' AND end IS NOT NULL")
    same = F.when(F.col("_ev").isNotNull() & (F.col("_ev") != F.col("video")), F.raise_error(F.concat(F.lit("another video ends: "), F.col("_ev")))).otherwise(F.lit(True)).cast("boolean")
    m = m.where(same).withColumn("is_abort", F.col("_ek") == "A")
    m = m if keep_aborted else m.where("NOT is_abort")
    rest = F.array_join(F.slice("tokens", 3, F.greatest(F.size("tokens") - 2, F.lit(0))), " ")
    return m.select(*keys, F.col("t").alias("start"), "end", "video", tag_map(rest).alias("params"), "is_abort", (F.row_number().over(w) - 1).cast("long").alias("trial"))


def blocks(messages: DataFrame, ends: DataFrame, keys: list[str], *, before: float = 0.02, tiebreak: tuple[str, ...] = ("pos", "message")) -> DataFrame:
    """Blocks from BLK messages `S kind ...`, `E`, `A` (as E): start, end, kind, block. A block without an end gets one `before` its successor's start, the
    last one at the series' last sample (ends: keys, last)."""
    w = W.partitionBy(*keys).orderBy("t", *(c for c in tiebreak if c in messages.columns))
    m = tag_lists(messages, "BLK").withColumn("_k", F.when(F.get("tokens", F.lit(0)) == "S", "S").otherwise("E"))
    m = m.withColumn("_nk", F.lead("_k").over(w)).withColumn("_nt", F.lead("t").over(w)).where("_k = 'S'").join(ends, keys, "left")
    end = F.when(F.col("_nk") == "E", F.col("_nt")).when(F.col("_nk") == "S", F.col("_nt") - before).otherwise(F.col("last"))
    return m.select(*keys, F.col("t").alias("start"), end.alias("end"), F.get("tokens", F.lit(1)).alias("kind"), (F.row_number().over(w) - 1).cast("long").alias("block"))


def trials_in_blocks(trial: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """trials with block, kind and trial_in_block of the block that they start in (start >= its start) and end in (end < its end); null otherwise. Blocks of a series
    don't overlap, so the latest start before a trial decides: an as-of join instead of a range join."""
    b = block.select(*keys, F.col("start").alias("t"), F.col("end").alias("b_end"), "block", "kind")
    out = asof(trial.withColumn("t", F.col("start")), b, ["b_end", "block", "kind"], Axis(tuple(keys), "t", ()))
    inside = F.coalesce(F.col("end") < F.col("b_end"), F.lit(False))
    out = out.withColumn("block", F.when(inside, F.col("block"))).withColumn("kind", F.when(inside, F.col("kind")))
    n = F.when(F.col("block").isNotNull(), F.row_number().over(W.partitionBy(*keys, "block").orderBy("start")) - 1)
    return out.withColumn("trial_in_block", n.cast("long")).drop("t", "b_end", "t_r")


def triggers(trial: DataFrame, trigger: DataFrame, keys: list[str]) -> DataFrame:
    """trials with the latest trigger at or before their start: trigger_t, trigger_offset, is_triggered."""
    out = asof(trial.withColumn("t", F.col("start")), trigger.select(*keys, "t", F.col("t").alias("trigger_t")), ["trigger_t"], Axis(tuple(keys), "t", ()))
    return out.withColumn("trigger_offset", F.col("start") - F.col("trigger_t")).withColumn("is_triggered", F.col("trigger_t").isNotNull()).drop("t", "t_r")
