"""Repeated passages by compressed FM-indexes.

A window is `window` consecutive words. Windows that occur more than once anywhere are found by backward search in FM-indexes (wavelet
matrices over the Burrows-Wheeler transform, bits packed, with block counts): matching statistics say how far back from each end a
text of the shard goes on occurring at least twice; ends that reach `window` words are repeats.

Shards are made by content, so that no document needs to meet all indexes. Of a window's word GRAM-grams, the one with the smallest hash
is its anchor; consecutive windows with the anchor at one place make a segment (window + up to window - GRAM words). Equal
windows have equal anchors, so all occurrences of a window are segments of one anchor, and of one shard. Segments whose anchor occurs
once, nearly all, end after counting. Equal segments are one, with a multiplicity: a segment that occurs twice is repeated whole.
Only different segments of one anchor, the edges of repeated passages, are indexed and streamed through the search.

Scale: what is shuffled of all text is 12 bytes an anchor, and one narrow row a segment; words go on only for segments of shared anchors,
one of each kind. Texts are compressed before they meet their document's intervals. A shard has about SHARD_SEGMENTS segments. An
anchor with more than HOT_SEGMENTS different segments (a passage of few more words than a window, with ever different neighbours)
isn't brought to one task. Its windows share nearly all their grams, so no second anchor would part them: they are grouped as
whole windows, byte by byte, with map-side combining.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, written

GRAM = 12
SHARD_SEGMENTS = 4000
HOT_SEGMENTS = 40_000
_BASE = 0xD6E8FEB86659FD93 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, np.uint64))))
        _inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64))))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def prefix(words: list[bytes]) -> np.ndarray:
    """Sums from which span() hashes any run of the words."""
    from xxhash import xxh64_intdigest

    _grow(len(words) + 1)
    h = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    return np.concatenate(([np.uint64(0)], np.cumsum(h * _powers[: len(h)], dtype=np.uint64)))


def span(sums: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return _mix((sums[start + n] - sums[start]) * _inverse[start])


def segments(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's windows: anchor, hash, first window and number of windows of each segment."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    sums = prefix(words)
    gram = min(GRAM, window)
    g = span(sums, np.arange(len(words) - gram + 1), gram)
    at, width, wide = np.arange(len(g)), 1, window - gram + 1
    while width < wide:  # the leftmost smallest of width grams from each on
        step = min(width, wide - width)
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        width += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    return g[at[first]], span(sums, first, count + window - 1), first, count


class FMIndex:
    """Counts of symbol sequences in a text of symbols from 2 on; 0 ends it, 1 parts it."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        k = 1
        while True:  # suffixes by doubling prefixes
            second = np.full(n, -1, np.int64)
            second[:-k] = rank[k:]
            key = rank * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            ends = np.concatenate(([False], key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(ends)
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        bwt = text[order - 1]
        size = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.levels = max(1, (size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            words = np.packbits(np.pad(bit, (0, -n % 64 + 64)), bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.start = self._follow(np.arange(size), np.zeros(size, np.int64))
        self.n = n

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = i >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol followed by what [low, high) stands for."""
        both = self._follow(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.before[symbol] - self.start[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """For each end (exclusive): how many symbols back from it occur at least twice together, most at most."""
        out = np.zeros(len(ends), np.int64)
        active, low, high = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(1, most + 1):
            low, high = self.step(text[ends[active] - k], low, high)
            go = high - low > 1
            active, low, high = active[go], low[go], high[go]
            if not len(active):
                break
            out[active] = k
        return out


def repeated_windows(bodies: list[bytes], times: list[int], window: int) -> list[int]:
    """Of each of some different segments the windows, as bits, that occur more than once in all of them."""
    split = [b.split(b" ") for b in bodies]
    ids: dict[bytes, int] = {}
    text = np.array([x for words in split for x in (*(ids.setdefault(w, len(ids) + 2) for w in words), 1)] + [0], np.int64)
    sizes = np.array([len(w) for w in split])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    once = np.flatnonzero(np.array(times) == 1)
    windows = sizes[once] - window + 1
    owner = np.repeat(once, windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = FMIndex(text).matching(text, starts[owner] + place + window, window) == window if len(owner) else np.empty(0, bool)
    out = np.where(np.array(times) > 1, (np.int64(1) << np.minimum(sizes - window + 1, 62)) - 1, 0)
    np.bitwise_or.at(out, owner[hit], np.int64(1) << place[hit])
    return out.tolist()


def _grouped(batch: pa.RecordBatch, column: str) -> Iterator[list[dict]]:
    for x in batch.column(column):
        yield x.as_py() or []


def repeats(docs: DataFrame, pressed: DataFrame, window: int) -> DataFrame:
    """doc, at: array of struct(first, flags): of each document with repeated windows its segments that have some, and which. docs:
    doc (struct of doc_id and text_hash), text; pressed: doc, z (compressed text)."""
    import zstandard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [segments(words_of(t.as_py()), window) for t in b.column("text")]
            rows = np.repeat(np.arange(b.num_rows), [len(p[0]) for p in parts])
            cat = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4)]
            arrays = [pa.array(x.astype(np.uint64).view(np.int64)) for x in cat[:2]] + [b.column("doc").take(pa.array(rows)), pa.array(cat[2].astype(np.int32)), pa.array(cat[3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "seg", "doc", "first", "n"])

    doc_type = "struct<doc_id: bigint, text_hash: bigint>"
    every = written(docs.select("doc", "text").mapInArrow(cut, f"anchor long, seg long, doc {doc_type}, first int, n int"), "anchors")
    # Written, so that both sides of the join come straight from a shuffle and AQE can split an anchor that is everywhere.
    shared = written(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("anchor").alias("a")), "shared-anchors")
    some = written(every.join(shared, F.col("anchor") == F.col("a"), "left_semi"), "segments")
    kinds = some.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "first")).alias("rep"), F.first("n").alias("n"))
    kinds = written(kinds, "kinds")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("anchor").alias("a"), "kinds")
    edges = written(kinds.join(mixed, F.col("anchor") == F.col("a")).drop("a"), "edges")
    flat = kinds.join(mixed, F.col("anchor") == F.col("a"), "left_anti").select("anchor", "seg", F.expr("shiftleft(1L, n) - 1").alias("flags"))

    wanted = edges.groupBy(F.col("rep.doc").alias("d")).agg(F.collect_list(F.struct("anchor", "seg", "times", "kinds", F.col("rep.first").alias("first"), "n")).alias("want"))
    texts = pressed.join(wanted, F.col("doc").eqNullSafe(F.col("d")))  # equal rows of docs come twice; search() takes one

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        names = ["anchor", "seg", "times", "kinds"]
        for b in batches:
            for z, want in zip(b.column("z"), _grouped(b, "want"), strict=True):
                words = inflate.decompress(z.as_py()).split()
                columns = [pa.array([w[c] for w in want], pa.int64()) for c in names]
                bodies = [b" ".join(words[w["first"] : w["first"] + w["n"] + window - 1]) for w in want]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], [*names, "body"])

    bodies = texts.select("z", "want").mapInArrow(fetch, "anchor long, seg long, times long, kinds long, body binary")
    shards = max(1, -(-edges.count() // SHARD_SEGMENTS))

    def search(rows: pa.Table) -> pa.Table:
        _, at = np.unique(np.column_stack([rows["anchor"].to_numpy(), rows["seg"].to_numpy()]), axis=0, return_index=True)
        rows = rows.take(pa.array(at))
        flags = repeated_windows(rows["body"].to_pylist(), rows["times"].to_pylist(), window)
        return rows.select(["anchor", "seg"]).append_column("flags", pa.array(flags, pa.int64()))

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    hot = not edges.where(F.col("kinds") > HOT_SEGMENTS).isEmpty()
    if hot:
        bodies = written(bodies, "bodies")
    found = bodies.where(F.col("kinds") <= HOT_SEGMENTS).select("anchor", "seg", "times", "body", shard).groupBy("shard").applyInArrow(search, "anchor long, seg long, flags long")
    if hot:
        found = found.unionByName(_by_bytes(bodies.where(F.col("kinds") > HOT_SEGMENTS).dropDuplicates(["anchor", "seg"]), window))
    flags = written(flat.unionByName(found.where("flags <> 0")), "flags").select(F.col("anchor").alias("a"), F.col("seg").alias("s"), "flags")
    hits = some.join(flags, (F.col("anchor") == F.col("a")) & (F.col("seg") == F.col("s"))).select("doc", "first", "flags").distinct()
    return hits.groupBy("doc").agg(F.collect_list(F.struct("first", "flags")).alias("at"))


def _by_bytes(bodies: DataFrame, window: int) -> DataFrame:
    """The flags of segments whose anchor is too common for one shard, by counting their windows' words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [x.split(b" ") for x in b.column("body").to_pylist()]
            windows = [[b" ".join(x[i : i + window]) for i in range(len(x) - window + 1)] for x in split]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(w) for w in windows]))
            places = pa.array([i for w in windows for i in range(len(w))], pa.int32())
            arrays = [pa.array([x for w in windows for x in w], pa.binary()), *(b.column(c).take(rows) for c in ("anchor", "seg", "times")), places]
            yield pa.RecordBatch.from_arrays(arrays, ["words", "anchor", "seg", "times", "place"])

    rows = written(bodies.select("anchor", "seg", "times", "body").mapInArrow(each, "words binary, anchor long, seg long, times long, place int"), "windows")
    again = rows.groupBy("words").agg(F.sum("times").alias("c")).where("c > 1").select(F.col("words").alias("again"))
    again = written(again, "windows-again")  # so that AQE can split a window that is everywhere
    return rows.join(again, F.col("words") == F.col("again")).groupBy("anchor", "seg").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("flags"))


def cover(n: int, at: list[dict], window: int) -> np.ndarray:
    """Which of n words flagged windows cover."""
    starts = [x["first"] + k for x in at for k in range(x["flags"].bit_length()) if x["flags"] >> k & 1]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.array(starts, np.int64), 1)
    np.add.at(mark, np.minimum(np.array(starts, np.int64) + window, n), -1)
    return np.cumsum(mark[:-1]) > 0


def substring_dedup(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, kept (its words outside of repeated windows, joined by one space), n_removed, removed
    (array of struct(first, n): the intervals of words that went).

    A word goes if a window of `window` words covers it whose words also start anywhere else, in this document or another; all
    occurrences go. window: GRAM to 74 words. Null text: no words. Texts shorter than a window keep all. Equal rows are documents of their
    own, so windows of such rows repeat. No rows: no rows. Other columns don't matter."""
    import zstandard

    if not GRAM <= window <= GRAM + 62:
        raise ValueError(f"window must be from {GRAM} to {GRAM + 62}")
    d = plain(docs, doc_id="doc_id:long", text="text:string")
    d = d.withColumn("doc", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [deflate.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(z, pa.binary())], ["doc", "z"])

    pressed = d.select("doc", "text").mapInArrow(press, "doc struct<doc_id: bigint, text_hash: bigint>, z binary")
    found = repeats(d.select("doc", "text"), pressed, window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for z, at in zip(b.column("z"), _grouped(b, "at"), strict=True):
                words = inflate.decompress(z.as_py()).split()
                gone = cover(len(words), at, window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if at else words
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                runs = [{"first": int(a), "n": int(e - a)} for a, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                for column, value in zip(out, (len(words), b" ".join(kept).decode("utf-8", "surrogatepass"), int(gone.sum()), runs), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_words", "kept", "n_removed", "removed"])

    met = pressed.join(found.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d")), "left")
    return met.select(F.col("doc.doc_id").alias("doc_id"), "z", "at").mapInArrow(finish, "doc_id long, n_words long, kept string, n_removed long, removed array<struct<first: int, n: int>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM p),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM dup, (SELECT unnest(range(0, 35)) AS j)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
