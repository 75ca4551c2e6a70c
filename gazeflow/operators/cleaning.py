"""Cleaning and reshaping of samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeflow.series import SERIES, Axis


def is_sentinel(value: str, *, limit: float, positive: bool = False, error: Column | None = None) -> Column:
    """True where a value stands for a missing one: beyond the limit, not positive, or flagged."""
    bad = F.abs(value) > limit
    if positive:
        bad = bad | (F.col(value) <= 0)
    return F.coalesce(bad if error is None else bad | error, F.lit(False))


def exclude_bad(df: DataFrame, columns: list[str], bad: str = "bad") -> DataFrame:
    return df.select(*(F.when(~F.col(bad), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def eyes_to_rows(df: DataFrame, suffixes: dict[str, str], eye: str = "eye") -> DataFrame:
    """Columns with each of the suffixes become rows: eye, and a column for each stem. All eyes need all stems. One pass, no shuffle."""
    stems = {k: [c[: -len(s)] for c in df.columns if c.endswith(s)] for k, s in suffixes.items()}
    names = next(iter(stems.values()))
    if any(set(x) != set(names) for x in stems.values()):
        raise ValueError(f"eyes have different columns: {stems}")
    wide = {n + s for s in suffixes.values() for n in names}
    kept = [c for c in df.columns if c not in wide]
    parts = F.array(*(F.struct(F.lit(k).alias(eye), *(F.col(n + s).alias(n) for n in names)) for k, s in suffixes.items()))
    return df.select(*kept, F.explode(parts).alias("_e")).select(*kept, "_e.*")


def eye_columns(names: list[str], patterns: list[str], *, case_sensitive: bool = False, drop_words: tuple[str, ...] = ()) -> dict[str, tuple[str, str]]:
    """Column: (eye, variable). The groups that a pattern captures are the eye, the rest of the name the variable, without drop words and
    without `_- ` at its ends. A name that several patterns fit, an empty variable and equal results are errors."""
    out: dict[str, tuple[str, str]] = {}
    for name in names:
        hits = [m for p in patterns if (m := re.search(p, name, 0 if case_sensitive else re.I))]
        if len(hits) > 1:
            raise ValueError(f"several patterns fit {name}")
        if hits:
            m = hits[0]
            eye = "".join(g for g in m.groups() if g)
            rest = name[: m.start()] + name[m.end() :] if m.groups() and m.group(0) == eye else name.replace(eye, "", 1)
            for word in drop_words:
                rest = re.sub(re.escape(word), "", rest, flags=0 if case_sensitive else re.I)
            rest = rest.strip("_- ")
            if not rest:
                raise ValueError(f"nothing is left of {name}")
            if (eye, rest) in out.values():
                raise ValueError(f"{name} repeats {(eye, rest)}")
            out[name] = (eye, rest)
    return out


def separate_eyes(df: DataFrame, patterns: list[str], *, eye: str = "eye", case_sensitive: bool = False, drop_words: tuple[str, ...] = ()) -> DataFrame:
    """Wide columns to rows by patterns (see eye_columns()); a variable that an eye lacks is null."""
    found = eye_columns(df.columns, patterns, case_sensitive=case_sensitive, drop_words=drop_words)
    kept = [c for c in df.columns if c not in found]
    eyes, names = list(dict.fromkeys(e for e, _ in found.values())), list(dict.fromkeys(n for _, n in found.values()))
    at = {v: k for k, v in found.items()}
    kind = {n: df.schema[next(k for k, v in found.items() if v[1] == n)].dataType for n in names}
    row = lambda e: F.struct(F.lit(e).alias(eye), *((F.col(at[e, n]) if (e, n) in at else F.lit(None)).cast(kind[n]).alias(n) for n in names))
    return df.select(*kept, F.explode(F.array(*map(row, eyes))).alias("_e")).select(*kept, "_e.*")


def binocular(df: DataFrame, keys: list[str], order: list[str], value: str, *, apart: float | None = None) -> DataFrame:
    """One row per time of two eyes (eye L or R, value, bad): the mean of good eyes; where one alone is good it is moved by its mean
    distance from the binocular value. bad: none is good, or they are over `apart` from each other. One aggregation, one window."""
    pick = lambda e, c: F.max(F.when(F.col("eye") == e, F.col(c)))
    b = df.groupBy(*keys, *order).agg(pick("L", value).alias("_l"), pick("R", value).alias("_r"), pick("L", "bad").alias("_lb"), pick("R", "bad").alias("_rb"))
    lg, rg = ~F.col("_lb") & F.col("_l").isNotNull(), ~F.col("_rb") & F.col("_r").isNotNull()
    lg, rg = F.coalesce(lg, F.lit(False)), F.coalesce(rg, F.lit(False))
    mid, w = (F.col("_l") + F.col("_r")) / 2, W.partitionBy(*keys)
    shift = lambda c: F.avg(F.when(lg & rg, mid - F.col(c))).over(w)
    x = F.when(lg & rg, mid).when(lg, F.col("_l") + shift("_l")).when(rg, F.col("_r") + shift("_r"))
    bad = ~(lg | rg)
    if apart is not None:
        bad = bad | (lg & rg & (F.abs(F.col("_l") - F.col("_r")) > apart))
    return b.select(*keys, *order, bad.alias("bad"), (lg != rg).alias("one_eye"), x.alias(value))


def sufficiency(df: DataFrame, value: str, keys: list[str], share: float, least: int) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), good.alias("good"), ((n < least) | (good < share * n) | (good < least)).alias("not_enough"))


def below_quantile(df: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    cut = F.expr(f"percentile({value}, {q}) OVER (PARTITION BY {', '.join(keys)})")
    return df.withColumn("_q", cut).where(F.col(value) < F.col("_q")).drop("_q")


def chunked(df: DataFrame, width: float, per_page: int, axis: Axis = SERIES) -> DataFrame:
    """Adds chunk (of width from the series' first time) and page (of per_page chunks)."""
    chunk = F.floor((F.col(axis.time) - F.min(axis.time).over(axis.whole)) / width)
    return df.withColumn("chunk", chunk.cast("long")).withColumn("page", F.floor(F.col("chunk") / per_page).cast("long"))


def row_mean(*columns: str) -> Column:
    """The mean of those that aren't missing; null if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)), n)


def centred_px(df: DataFrame, params: DataFrame, keys: list[str], x: str, y: str, flip_y: float = -1.0) -> DataFrame:
    """Adds cx_px, cy_px: from the centre of the series' calibrated rectangle (params: left, top, right, bottom), y times flip_y."""
    df = df.join(params.select(*keys, "left", "top", "right", "bottom"), keys, "left")
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    return df.withColumn("cx_px", F.col(x) - cx).withColumn("cy_px", (F.col(y) - cy) * flip_y).drop("left", "top", "right", "bottom")


#: Event types and eye codes of a tracker's log.
EVENT_LABELS = {"saccade": "SACC", "fixation": "FIXA", "blink": "BLNK"}
EYES = {0: "L", 1: "R"}


def clean_events(df: DataFrame, *, unit_s: float = 1e-3, eyes: tuple[str, ...] = ("L", "R")) -> DataFrame:
    """type, start, end, eye of a tracker to label, stsec, ensec, dursec, eye; other types in upper case, other eyes go."""
    table = lambda m, c: F.coalesce(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[c], F.lit(None))
    label = F.coalesce(table(EVENT_LABELS, F.lower("type")), F.upper("type"))
    df = df.withColumn("label", label).withColumn("eye", table(EYES, F.col("eye"))).where(F.col("eye").isin(*eyes))
    return df.withColumn("stsec", F.col("start") * unit_s).withColumn("ensec", F.col("end") * unit_s).withColumn("dursec", F.col("ensec") - F.col("stsec")).drop("type", "start", "end")


def single_gaps_filled(value: str, axis: Axis = SERIES) -> Column:
    """A missing value between two known ones becomes their mean in steps (half-way); longer gaps stay."""
    v = F.col(value)
    return F.coalesce(v, (F.lag(value).over(axis.w) + F.lead(value).over(axis.w)) / 2)
