"""Quality rules by cross-document line frequency.

Lines are normalised (case, white space) and hashed; of each host the distinct documents that hold a line are counted. Lines
above a limit are boilerplate and are removed, and documents of which too little is left are rejected. Everything is DataFrame
code.

Scale: a document sends each of its line hashes once, 8 bytes and keys; counts combine before the shuffle. A line above the
limit is on a fixed share of its host's documents, so a host has at most (its mean lines a document / max_share) such lines:
they come to the documents as one array per host, however large the host is. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, packed, table, words_sql, written

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: A line is boilerplate on more than this share of its host's documents, and on more than MIN_DOCS of them.
MAX_SHARE = 0.1
MIN_DOCS = 20
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5

_BLANKS = r"btrim({x}, ' \t\n\u000b\f\r')"
_NORM = r"lower(regexp_replace(btrim({x}, ' \t\u000b\f\r'), '[\\x20\\x09-\\x0D]+', ' '))"
_LINES = f"filter(split(coalesce(text, ''), '\\n'), x -> {_BLANKS.format(x='x')} <> '')"

# Windows are compared by their 64-bit hashes; where a text has equal ones, their starts are found by sorting, and the words
# covered are the gaps between starts, each at most one window.
_REPEATS = f"""
CASE WHEN n_words <= {REPEAT_WINDOW} OR size(array_distinct(windows)) = size(windows) THEN 0L ELSE
  element_at(transform(array(sort_array(transform(windows, (x, i) -> struct(x AS h, i AS i)))), s ->
    element_at(transform(array(sort_array(transform(filter(sequence(0, size(s) - 1), i ->
        (i > 0 AND s[greatest(i - 1, 0)].h = s[i].h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = s[i].h)), i -> s[i].i))), p ->
      aggregate(sequence(0, size(p) - 1), 0L, (total, i) -> total + CASE WHEN i = size(p) - 1 THEN {REPEAT_WINDOW} ELSE least({REPEAT_WINDOW}, p[i + 1] - p[i]) END)), 1)), 1)
END"""


def text_signals(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of column text."""
    df = df.withColumn("words", F.expr(words_sql("text"))).withColumn("n_words", F.expr("cast(size(words) AS long)"))
    windows = f"CASE WHEN n_words < {REPEAT_WINDOW} THEN cast(array() AS array<long>) ELSE element_at(transform(array(words), w -> transform(sequence(1, size(w) - {REPEAT_WINDOW - 1}), i -> xxhash64(slice(w, i, {REPEAT_WINDOW})))), 1) END"
    df = df.withColumn("windows", F.expr(windows)).withColumn("raw_lines", F.expr(_LINES))
    df = df.withColumn("n_repeat_words", F.expr(_REPEATS))
    df = df.withColumn("word_chars", F.expr("cast(char_length(array_join(words, '')) AS long)"))
    df = df.withColumn("n_symbols", F.expr("cast(coalesce(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]', '')), 0) AS long)"))
    df = df.withColumn("n_dup_lines", F.expr("cast(size(raw_lines) - size(array_distinct(raw_lines)) AS long)"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("words", "windows")


def frequent_lines(df: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """Per host with such lines: h, frequent: the hashes of its boilerplate lines. df: doc_id, text, host."""
    lines = df.select("host", "doc_id", F.expr(f"array_distinct(transform({_LINES}, x -> xxhash64({_NORM.format(x='x')})))").alias("hashes"))
    docs = df.groupBy("host").agg(F.countDistinct("doc_id").alias("docs"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    docs = docs.select(F.col("host").alias("h"), (F.col("docs") + F.col("nulls").cast("long")).alias("host_docs"))
    each = lines.select("host", F.struct("doc_id").alias("doc"), F.explode("hashes").alias("line")).distinct()  # a struct: a null id counts too
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    over = counts.join(docs, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_docs") > max_share * F.col("host_docs"))
    return over.groupBy("h").agg(F.collect_list("line").alias("frequent"))


def line_frequency_rules(docs: DataFrame, *, host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The columns of docs, then struct `rules`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_lines, n_removed_words, kept, clean_text (the lines that aren't boilerplate).

    A document is kept unless base_failed (under MIN_WORDS words, or over REPEAT_PERCENT % of its words in windows of
    REPEAT_WINDOW words that its text repeats) or depleted (without its boilerplate lines, under MIN_WORDS words or under
    min_left of its words).

    Null text is an empty one: no words, base_failed, clean_text empty. A null host is a host of its own. Rows with equal
    doc_id count as one document for line frequencies (null ids: as one), and each gets its own verdict. No rows: no rows.
    A column of docs that is itself named rules stays, before this one; rules_of() keeps them apart."""
    out, names = rules_of(docs, host=host, max_share=max_share, min_docs=min_docs, min_left=min_left)
    fields = F.struct(*(F.col(c) for c in _FIELDS)).alias("rules")
    return out.select(*(F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(names))), fields).toDF(*names, "rules")


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept", "clean_text")


def rules_of(docs: DataFrame, *, host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> tuple[DataFrame, list[str]]:
    """row (the columns of docs as a struct), doc_id and the fields of line_frequency_rules(); and the names of docs."""
    rows, names = packed(docs, doc_id="doc_id:long", text="text:string", host=f"{host}:string")
    found = written(frequent_lines(rows.select("doc_id", "text", "host"), max_share, min_docs), "frequent-lines")
    hashes = found.agg(F.coalesce(F.sum(F.size("frequent") + 1), F.lit(0))).first()[0]
    out = text_signals(rows).join(maybe_broadcast(found, hashes), F.col("host").eqNullSafe(F.col("h")), "left")
    line_hash = f"xxhash64({_NORM.format(x='x')})"
    hit = f"CASE WHEN frequent IS NULL THEN cast(array() AS array<long>) ELSE array_intersect(transform(raw_lines, x -> {line_hash}), frequent) END"
    out = out.withColumn("hit", F.expr(hit))
    gone = f"CASE WHEN size(hit) = 0 THEN cast(array() AS array<string>) ELSE element_at(transform(array(hit), b -> filter(raw_lines, x -> array_contains(b, {line_hash}))), 1) END"
    out = out.withColumn("gone", F.expr(gone)).withColumn("n_removed_lines", F.expr("cast(size(gone) AS long)"))
    out = out.withColumn("n_removed_words", F.expr(f"aggregate(gone, 0L, (n, x) -> n + size({words_sql('x')}))"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))
    clean = f"CASE WHEN size(hit) = 0 THEN coalesce(text, '') ELSE array_join(element_at(transform(array(hit), b -> filter(split(text, '\\n'), x -> {_BLANKS.format(x='x')} = '' OR NOT array_contains(b, {line_hash}))), 1), '\\n') END"
    return out.withColumn("clean_text", F.expr(clean)), names


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = rules_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    lower(regexp_replace(trim(line, E' \t\x0b\x0c\r'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, E'\n')) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
freq AS (SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.norm, h.docs HAVING count(DISTINCT l.doc_id) > 20 AND count(DISTINCT l.doc_id) > 0.1 * h.docs),
gone AS (SELECT doc_id, count(*) AS n, sum(l.n) AS gone_words FROM lines l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY doc_id),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
o AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_lines, coalesce(gone.gone_words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
p AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.5 * n_words AS kept, n_removed_lines, n_removed_words FROM p
"""
