"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis, 2006).

Each document gets the key -ln(u) / w, where u is a uniform number made from the document's id and w its quality weight.
Sources get word targets; of each source whole epochs are taken first, and the rest of its target goes to the documents with
the smallest keys, by prefix sums of their sizes; the document at the cut is taken in part, so that the target is met to a
word. Everything is DataFrame code.

Scale: sums per source and per (source, key range) find the one key range that holds a source's cut; only this range, about
RANGE_ROWS documents, is sorted. No source's documents meet in one task, and the decision per source is one row, which is
joined to the documents. All shuffles carry pre-aggregated sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, packed, plain, table, unpacked, words_sql, written

#: About so many documents share a key range.
RANGE_ROWS = 2000
#: Characters that count against a document's quality.
ODD = r"[0-9#*$%&|<>!?{}\[\]\\/_=+~^@]"


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of non-space characters that aren't digits or symbols (no such: 0.05)."""
    dense = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")
    plain_chars = F.char_length(F.regexp_replace(dense, ODD, ""))
    return F.lit(0.05) + F.lit(0.95) * F.when(F.char_length(dense) > 0, plain_chars / F.char_length(dense)).otherwise(0.0)


def _sized(df: DataFrame) -> DataFrame:
    """doc_id, source, size, p: a document's key is -ln(u) / w; p = 1 - exp(-key) orders as the key does, within 0 to 1."""
    hexed = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12)
    u = (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 48)
    out = df.withColumn("size", F.expr(f"cast(size({words_sql('text')}) AS long)"))
    out = out.withColumn("key", -F.log(u) / quality(F.col("text")))
    return out.withColumn("p", F.lit(1.0) - F.exp(-F.col("key")))


def source_plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: source_size, target, epochs (whole ones), and the cut: documents with (key, doc_id) below (cut_key,
    cut_id) are taken once more, those at it with cut_take words each."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    sums = sums.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    sums = sums.withColumn("total", F.sum("source_size").over(W.partitionBy()) * float(share)).withColumn("w_all", F.sum("w").over(W.partitionBy()))
    # Sources fill up in the order of most / w: one is full if the level that fills it needs no more than the total.
    before = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    full_most, full_w = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    sums = sums.withColumn("full", full_most + F.col("most") / F.col("w") * (F.col("w_all") - full_w) <= F.col("total"))
    all_rows = W.partitionBy()
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_rows), F.lit(0.0))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(all_rows)
    sums = sums.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(rest * F.col("w") / rest_w))
    sums = sums.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sums = sums.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sums = sums.withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long"))
    sums = written(sums.select("source", "source_size", "target", "epochs", "rest", "ranges"), "mix-sources")

    key_range = F.least(F.col("ranges") - 1, F.floor(F.col("p") * F.col("ranges"))).cast("long")
    n = sums.count()
    s = maybe_broadcast(sums.select(F.col("source").alias("s"), "rest", "ranges").where("rest > 0"), n)
    placed = sized.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("key_range", key_range)
    sums_of = placed.groupBy("s", "key_range").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(W.partitionBy("s").orderBy("key_range"))
    cut_at = sums_of.withColumn("upto", upto).where("upto >= rest AND upto - size < rest").select(F.col("s").alias("t"), F.col("key_range").alias("cut_range"), (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))
    near = placed.join(cut_at, F.col("s").eqNullSafe(F.col("t")) & (F.col("key_range") == F.col("cut_range")))
    ties = near.groupBy("t", "key", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    upto = F.sum("size").over(W.partitionBy("t").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    cut = ties.withColumn("upto", upto).where("upto >= left AND upto - size < left")
    cut = cut.select("t", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.expr("(left - upto + size) div n").alias("cut_take"))
    out = sums.join(cut, F.col("source").eqNullSafe(F.col("t")), "left")
    return maybe_broadcast(out.select(F.col("source").alias("s"), "source_size", "target", "epochs", "cut_key", "cut_id", "cut_take"), n)


def _taken(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_size, target, epochs and taken."""
    below = F.col("key") < F.col("cut_key")
    id_below = F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull())
    at = F.col("key") == F.col("cut_key")
    extra = F.when(below | (at & id_below), F.col("size")).when(at & F.col("doc_id").eqNullSafe(F.col("cut_id")), F.least("cut_take", "size")).otherwise(F.lit(0))
    out = sized.join(sources, F.col("source").eqNullSafe(F.col("s")))
    return out.withColumn("extra", extra.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def mix_plan(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken (words that the mix takes of it).

    weights: of the sources in code-point order, null last, repeating. share: of the sum of all sizes that the mix takes.
    cap: times its own size that a source, and a document, is taken at most; what exceeds it goes to the other sources by
    weight.

    Null or blank text: size 0, taken 0. A null source is a source of its own. Rows with equal doc_id tie; where the cut
    falls on ties, they share what is left, rounded down. A null doc_id comes first among ties. No rows: no rows. Other
    columns don't matter."""
    sized = written(_sized(plain(docs, doc_id="doc_id:long", text="text:string", source="source:string")).drop("text"), "mix-sizes")
    out = _taken(sized, source_plan(sized, weights, share, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed documents, with the columns of docs: a document's row comes once for each whole time it is taken, and once
    more with its first words (joined by one space) if it is taken in part. Documents without words take no room in the mix
    and don't come. Same definitions as mix_plan()."""
    rows, names = packed(docs, doc_id="doc_id:long", text="text:string", source="source:string")
    sized = _sized(rows)
    narrow = written(sized.select("doc_id", "source", "size", "key", "p"), "mix-sizes")
    out = _taken(sized, source_plan(narrow, weights, share, cap)).where("taken > 0")
    part = F.expr(f"CASE WHEN extra > 0 AND extra < size THEN array(array_join(slice({words_sql('text')}, 1, cast(extra AS int)), ' ')) ELSE cast(array() AS array<string>) END")
    whole = F.expr("array_repeat(text, cast(epochs AS int) + CASE WHEN extra = size THEN 1 ELSE 0 END)")
    out = out.select("row", F.explode(F.concat(whole, part)).alias("new_text"))
    return unpacked(out, names, {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS dense,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
k AS (
  SELECT doc_id, source, size, -ln(u) / (0.05 + 0.95 * CASE WHEN length(dense) > 0
    THEN length(regexp_replace(dense, '[0-9#*$%&|<>!?{}\[\]\\/_=+~^@]', '', 'g')) / length(dense)::DOUBLE ELSE 0.0 END) AS key FROM d),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM k GROUP BY source),
s1 AS (SELECT *, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS w_all FROM s0),
s2 AS (
  SELECT *, coalesce(sum(most) OVER b, 0) + most / w * (w_all - coalesce(sum(w) OVER b, 0)) <= total AS is_full FROM s1
  WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT source, source_size, CASE WHEN is_full THEN most ELSE
    (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s3),
r AS (
  SELECT k.doc_id, k.size, s4.source_size, s4.target, s4.epochs, k.source, floor(s4.target - s4.epochs * s4.source_size)::BIGINT AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN s4 ON k.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken, source FROM r
"""
