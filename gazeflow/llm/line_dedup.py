"""Line deduplication by content-defined chunks of lines.

Every line has a hash; a rolling hash joins those of a line and the two before it. A chunk ends after a line whose rolling
hash is a local minimum, so boundaries depend on nearby lines only and come back soon after an insertion. Each chunk has two
lines at least. A chunk whose bytes occur more than once in all documents stays at its first place and goes elsewhere.
Everything is DataFrame code. deduplicated() is the form for pipelines, which may not miss short blocks: a boundary at every line.

Scale: chunk hashes (8 bytes a chunk) are counted first; only chunks whose hash repeats send their text, and equal texts
combine before the shuffle, so that a chunk on a third of all documents sends one row per task. Sides are broadcast only up to
a counted number of rows; beyond it they are joined by shuffle, where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, maybe_broadcast, packed, plain, table, unpacked, written

#: So many 8-byte hashes are broadcast at most.
HASHES = 2_000_000
_LINES = "split(text, '\\n')"
_LINE_HASH = "cast(conv(substring(md5(cast(x AS binary)), 1, 8), 16, 10) AS long)"
#: From the hashes of the lines of a text: the rolling hash at each.
_ROLL = """transform(h, (x, i) -> (x + 31 * (CASE WHEN i > 0 THEN h[greatest(i - 1, 0)] ELSE 0L END)
  + 961 * (CASE WHEN i > 1 THEN h[greatest(i - 2, 0)] ELSE 0L END)) % 2147483647)"""
#: From the rolling hashes: the last line of each chunk.
_ENDS = """filter(sequence(0, size(r) - 1), i -> i = size(r) - 1 OR
  (i >= 1 AND i <= size(r) - 3 AND r[greatest(i - 1, 0)] > r[i] AND r[i] <= r[least(i + 1, size(r) - 1)]))"""


#: A chunk's start and length as one number, so that sets of them are hashed.
_CODE = "(shiftleft(cast({} AS bigint), 32) | {})"


def _bind(value: str, name: str, body: str) -> str:
    """SQL for body, in which name is value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def with_chunks(df: DataFrame) -> DataFrame:
    """Adds lines, and chunks: array of struct(start, n, body). Null text has neither."""
    ends = _bind(f"transform({_LINES}, x -> {_LINE_HASH})", "h", _bind(_ROLL, "r", _ENDS))
    each = _bind("ends", "e", "transform(e, (x, i) -> struct(CASE WHEN i = 0 THEN 0 ELSE e[greatest(i - 1, 0)] + 1 END AS start, x AS last))")
    df = df.withColumn("ends", F.expr(ends)).withColumn("spans", F.expr(each))
    body = _bind(_LINES, "l", "transform(spans, s -> struct(s.start AS start, s.last - s.start + 1 AS n, array_join(slice(l, s.start + 1, s.last - s.start + 1), '\\n') AS body))")
    return df.withColumn("chunks", F.expr(body)).drop("ends", "spans")


def _keyed(df: DataFrame) -> DataFrame:
    """A document is known by doc_id and the hash of its text."""
    return df.withColumn("doc", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc, gone, gone_lines: of each document that loses chunks, these as codes of start and length, and their lines. docs: doc_id,
    text, doc."""
    each = with_chunks(docs.where("text IS NOT NULL").select("doc", "text")).select("doc", F.explode("chunks").alias("c")).where("c.n > 1")
    hashed = written(each.select("doc", F.xxhash64("c.body").alias("h"), "c.start", "c.n").distinct(), "line-chunks")
    again = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("again"))
    again = written(again, "line-again")
    some = maybe_broadcast(again, again.count())
    bodies = each.select("doc", F.xxhash64("c.body").alias("h"), F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.col("c.body").alias("body"))
    bodies = bodies.join(some, F.col("h") == F.col("again"), "left_semi")
    # Equal bytes meet here: grouping by the body itself compares them.
    first = bodies.groupBy("h", "body").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("c")).select("h", F.xxhash64(F.reverse("body")).alias("check"), "first", "c")
    first = written(first, "line-first")
    texts = first.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.first("first").alias("first"), F.first("c").alias("c"))
    single = texts.where("texts = 1 AND c > 1").select(F.col("h").alias("again"), "first")
    n = first.count()
    gone = hashed.join(maybe_broadcast(single, n), F.col("h") == F.col("again")).where(~F.struct("doc", "start").eqNullSafe(F.col("first"))).select("doc", "start", "n")
    shared = texts.where("texts > 1").select(F.col("h").alias("again"))
    if not shared.isEmpty():  # different texts with one 64-bit hash: told apart by a second hash of the bytes as well
        own = first.join(shared, F.col("h") == F.col("again"), "left_semi").where("c > 1").select(F.col("h").alias("again"), F.col("check").alias("check2"), "first")
        own = bodies.join(own, (F.col("h") == F.col("again")) & (F.xxhash64(F.reverse("body")) == F.col("check2"))).where(~F.struct("doc", "start").eqNullSafe(F.col("first")))
        gone = gone.unionByName(own.select("doc", "start", "n").distinct())
    return gone.groupBy("doc").agg(F.collect_list(F.expr(_CODE.format("start", "n"))).alias("gone"), F.sum("n").alias("gone_lines"))


def _counted(gone: DataFrame) -> DataFrame:
    """gone with a broadcast hint if its lists are short all together: a narrow row has about five numbers."""
    return maybe_broadcast(gone, gone.agg(F.coalesce(F.sum(F.size("gone") + 5), F.lit(0))).first()[0] // 5)


def line_dedup(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """row (the columns of docs as a struct), doc_id, text, kept_text, n_lines, n_chunks, n_removed_chunks, n_removed_lines; and the
    names of docs.

    Lines end at \\n, empty ones count too. A chunk that repeats stays at its smallest (doc_id, text's hash, place) and is
    removed elsewhere, also within one document. A text of one line is never touched. Null text: kept_text null, no lines;
    empty text: one empty line. Rows that are equal in doc_id and text are one document: they lose the same chunks. Of a null
    doc_id the text's hash decides, and it comes before other ids. No rows: no rows. Other columns pass through."""
    rows, names = packed(docs, doc_id="doc_id:long", text="text:string")
    rows = _keyed(rows)
    gone = written(repeated_chunks(_keyed(plain(docs, doc_id="doc_id:long", text="text:string"))), "line-gone")
    out = with_chunks(rows).join(_counted(gone).withColumnRenamed("doc", "lost"), F.col("doc").eqNullSafe(F.col("lost")), "left")
    left = f"array_except(transform(chunks, c -> {_CODE.format('c.start', 'c.n')}), gone)"
    kept = _bind(_LINES, "l", f"array_join(transform({left}, k -> array_join(slice(l, cast(shiftright(k, 32) AS int) + 1, cast(k & 4294967295 AS int)), '\n')), '\n')")
    kept = f"CASE WHEN text IS NULL OR gone IS NULL THEN text ELSE {kept} END"
    out = out.select("row", "doc_id", "text", F.expr(kept).alias("kept_text"), F.expr(f"cast(CASE WHEN text IS NULL THEN 0 ELSE size({_LINES}) END AS long)").alias("n_lines"), F.expr("cast(coalesce(size(chunks), 0) AS long)").alias("n_chunks"), F.expr("cast(CASE WHEN gone IS NULL THEN 0 ELSE size(gone) END AS long)").alias("n_removed_chunks"), F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_removed_lines"))
    return out, names


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc, gone: of each document that loses lines, their places. docs: doc_id, text, doc.

    The chunks here are the smallest that have more than one line, with a boundary at every line: pairs of adjacent lines. Of
    a pair whose bytes occur more than once all but the first place lose both lines, except lines that also belong to the first
    place of another such pair."""
    pair = "struct(i AS at, xxhash64(x, l[i + 1]) AS h, xxhash64(l[i + 1], 1L, x) AS g{})"
    pairs = lambda more: F.expr(_bind(_LINES, "l", f"transform(slice(l, 1, size(l) - 1), (x, i) -> {pair.format(more)})"))
    some = docs.where("text IS NOT NULL AND instr(text, '\n') > 0")
    each = some.select("doc", F.explode(pairs("")).alias("p")).select("doc", "p.at", "p.h", "p.g")
    each = written(each.distinct(), "line-pairs")
    again = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("again")), "line-pairs-again")
    bodies = some.select("doc", F.explode(pairs(", concat_ws('\n', x, l[i + 1]) AS body")).alias("p")).select("doc", "p.*")
    # One 8-byte column: a relation of HASHES rows is 64 MB at most. Without it the text of all pairs would be shuffled.
    bodies = bodies.join(maybe_broadcast(again, again.count(), HASHES), F.col("h") == F.col("again"), "left_semi")
    # Equal bytes meet here, as in repeated_chunks(). Rows that are equal in document and place are one.
    same = bodies.groupBy("h", "g", "body").agg(F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("final"))
    same = same.groupBy(F.col("h").alias("h1"), F.col("g").alias("g1")).agg(F.count(F.lit(1)).alias("texts"), F.first("first").alias("first"), F.first("final").alias("final"))
    # Different texts with the same 128 bits would be left alone.
    first = written(same.where("texts = 1 AND first <> final").drop("texts", "final"), "line-pairs-first")
    marked = each.join(first, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")))
    marked = marked.select("doc", "at", F.struct("doc", "at").eqNullSafe(F.col("first")).alias("stays"))
    out = marked.groupBy("doc").agg(*(F.collect_list(F.when(F.col("stays") == x, F.col("at"))).alias(k) for k, x in (("again", False), ("held", True)))).where("size(again) > 0")
    both = "concat({0}, transform({0}, x -> x + 1))"
    out = out.select("doc", F.expr(f"array_except({both.format('again')}, {both.format('held')})").alias("gone")).where("size(gone) > 0")
    out = written(out, "line-gone")
    dropped(each, again, first)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The columns of docs without repeated blocks of two lines or more (see repeated_lines()), wherever these begin and end;
    documents that lose all their lines go. Places are compared as in line_dedup(), and rows are treated as there."""
    rows, names = packed(docs, doc_id="doc_id:long", text="text:string")
    gone = _counted(repeated_lines(_keyed(plain(docs, doc_id="doc_id:long", text="text:string")))).withColumnRenamed("doc", "lost")
    out = _keyed(rows).join(gone, F.col("doc").eqNullSafe(F.col("lost")), "left")
    left = _bind(_LINES, "l", "transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i])")
    out = out.withColumn("left", F.expr(f"CASE WHEN gone IS NOT NULL THEN {left} END")).where("left IS NULL OR size(left) > 0")
    out = out.withColumn("kept_text", F.expr("CASE WHEN left IS NULL THEN text ELSE array_join(left, '\\n') END"))
    return unpacked(out, names, {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.col("kept_text").alias("text"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, string_split(text, E'\n') AS x FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = n - 1 OR (i >= 1 AND i <= n - 3 AND lag(r) OVER w > r AND r <= lead(r) OVER w) AS is_end FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, E'\n' ORDER BY i) AS body FROM g GROUP BY doc_id, chunk),
k AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, chunk) > 1 AS gone FROM c),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, sum(gone::INT)::BIGINT AS n_removed_chunks, sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS n_removed_lines,
    coalesce(string_agg(body, E'\n' ORDER BY chunk) FILTER (WHERE NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_chunks, 0) AS n_removed_chunks,
  coalesce(n_removed_lines, 0) AS n_removed_lines, d.text FROM documents LEFT JOIN d USING (doc_id)
"""
