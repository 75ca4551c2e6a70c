"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint's bit is the majority of that bit over the hashes of a text's word shingles. Links are found by an index of
positional bytes with count filtering: fingerprints that differ in at most d bits differ in at most d bytes, so at least
(bytes - d) positional bytes are shared. Every posting list stands for one set of that many positions, so whoever meets in
a list has reached the guaranteed count; the tally over all positions and the bit difference are then verified. Single bytes
would make lists of a 256th of all documents each, and a tally row for every pair in them; a set's list is what their
intersection is, without these pairs.

Scale: equal fingerprints are one node, so copies never meet as pairs; a list of the exact form shares all but d bytes, which
bounds it to 2^(8 d) nodes, whatever the number of documents (d = 2: 65,536). A list returns a forest, not its pairs. Lists with
one node, nearly all, end after counting. Components: see components.py. Only ids and fingerprints are shuffled, no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, maybe_broadcast, packed, plain, table, unpacked, written
from .components import components

SEED = 42
#: Shingles hashed at a time, so that memory doesn't grow with a text.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> bytes:
    """The 64-bit fingerprint of a whole text, most significant byte first. A-Z are lower-cased. No words: zeros; fewer words than a
    shingle has: their whole sequence is the shingle."""
    return fingerprint_of(hash_blocks(text, shingle))


def fingerprint_of(blocks: Iterable[np.ndarray]) -> bytes:
    """The fingerprint from the hashes of all shingles."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        n += len(h)
        counts += _bit_counts(h)
    return np.packbits(2 * counts > n).tobytes()


def hash_blocks(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, BLOCK at a time."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        pieces = [joined[a:b] for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        yield np.array([xxh64_intdigest(p, SEED) for p in pieces], np.uint64)


_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the most significant first. Every eighth bit is counted at once: eight one-byte sums in a
    word, of 255 hashes at most."""
    h = np.pad(h, (0, -len(h) % 255))
    out = np.empty((8, 8), np.int64)
    for k in range(8):
        sums = ((h >> np.uint64(k)) & _LANES).reshape(-1, 255).sum(axis=1)
        out[:, k] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()[::-1]


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, sig: binary. docs: doc_id, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(each, "doc_id long, text_hash long, sig binary")


def _postings(sig: Column, n_bytes: int, max_diff: int) -> Column:
    """The keys of the posting lists of a fingerprint: one for each set of positions. A set's list is the intersection of the lists of its
    single bytes: whoever is in it has a tally of as many shared bytes."""
    sets = list(combinations(range(n_bytes), n_bytes - max_diff))
    byte = [F.substring(sig, i + 1, 1) for i in range(n_bytes)]
    return F.array(*(F.xxhash64(F.lit(k), *(byte[i] for i in at)) for k, at in enumerate(sets)))


def forest(sigs: np.ndarray, max_diff: int, least_bytes: int) -> np.ndarray:
    """For each row of sigs (uint8): the row that it hangs on, so that rows are in one tree if and only if a chain of links
    joins them. A link: at least least_bytes equal positional bytes and at most max_diff different bits."""
    n = len(sigs)
    label = np.arange(n)

    def link_rows(i: int, linked: np.ndarray) -> None:
        hit = np.unique(label[np.append(linked, i)])
        if len(hit) > 1:
            label[np.isin(label, hit[1:])] = hit[0]

    varying = np.bitwise_or.reduce(sigs ^ sigs[0], axis=0) if n else sigs
    if n > 512 and sigs.shape[1] == 8 and int(np.bitwise_count(varying).sum()) <= 16 and max_diff <= 2:
        # All differ in a few bits only: look up each neighbour instead of comparing all pairs.
        v = sigs.copy().view(">u8").astype(np.uint64).ravel()
        order = np.argsort(v)
        flat = v[order]
        bits = [np.uint64(1 << (63 - i)) for i in np.flatnonzero(np.unpackbits(varying))]
        masks = [m for k in range(1, max_diff + 1) for c in combinations(bits, k) if (m := np.bitwise_or.reduce(np.array(c, np.uint64)))]
        partner = []
        for m in masks:
            at = np.minimum(np.searchsorted(flat, flat ^ m), n - 1)
            ok = np.flatnonzero(flat[at] == flat ^ m)
            partner.append((ok, at[ok]))
        own = np.arange(n)
        while True:
            old = own.copy()
            for a, b in partner:
                own[a] = np.minimum(own[a], own[b])
            own = own[own]
            if (own == old).all():
                break
        label[order] = order[own]
        return label
    wide = np.ascontiguousarray(sigs).view(np.uint64)
    for i in range(n - 1):
        diff = np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1, dtype=np.int32)
        near = np.flatnonzero(diff <= max_diff)
        if len(near):
            near = near[(sigs[near + i + 1] == sigs[i]).sum(axis=1) >= least_bytes]
            link_rows(i, near + i + 1)
            if (label == label[0]).all():
                break  # one tree: further links change nothing
    return label


def links(nodes: DataFrame, n_bytes: int, max_diff: int) -> DataFrame:
    """a, b: edges whose components are those of all links. nodes: node long, sig binary, each sig once."""
    rows = nodes.select("node", F.explode(_postings(F.col("sig"), n_bytes, max_diff)).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"))
    met = written(rows.join(shared, F.col("key") == F.col("k"), "left_semi"), "simhash-met")
    lists = met.join(nodes, "node").groupBy("key").agg(F.collect_list(F.struct("node", "sig")).alias("of"))
    least_bytes = max(n_bytes - max_diff, 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for of in batch.column(0):
                node = np.asarray(of.values.field("node"))
                sigs = np.frombuffer(b"".join(of.values.field("sig").to_pylist()), np.uint8).reshape(len(node), -1)
                root = forest(sigs, max_diff, least_bytes)
                hung = np.flatnonzero(root != np.arange(len(node)))
                a.append(node[hung])
                b.append(node[root[hung]])
            cat = lambda x: np.concatenate([np.empty(0, np.int64), *x])
            yield pa.RecordBatch.from_arrays([pa.array(cat(a), pa.int64()), pa.array(cat(b), pa.int64())], ["a", "b"])

    return lists.select("of").mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_diff: int = 2) -> DataFrame:
    """One row per document: doc_id, text_hash, sig, component_id (the smallest doc_id of those reachable over links), node
    (the group's own key), first (the group's first document: struct of no_id, doc_id, text_hash).

    shingle: words in one. max_diff: differing bits of a link at most. For groups by the similarity of shingle sets, see jaccard.py.

    Texts without words (also null ones) have zero fingerprints and link to each other. Equal rows are two documents of
    one group. Null ids: component_id is the smallest other one, or null. No rows: no rows."""
    sigs = written(with_fingerprints(plain(docs, doc_id="doc_id:long", text="text:string"), shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = written(sigs.groupBy("sig").agg(first).withColumn("node", F.conv(F.hex("sig"), 16, -10).cast("long")), "simhash-nodes")
    found = components(links(nodes.select("node", "sig"), 8, max_diff)).withColumnRenamed("node", "n")
    placed = written(nodes.join(found, F.col("node") == F.col("n"), "left").select("sig", "first", F.coalesce("root", "node").alias("node")), "simhash-placed")
    dropped(nodes)
    groups = placed.groupBy("node").agg(F.min("first").alias("first"))
    placed = placed.select("sig", "node").join(groups, "node").select(F.col("sig").alias("s"), "node", "first")
    return sigs.join(placed, F.col("sig") == F.col("s")).select("doc_id", "text_hash", "sig", F.col("first.doc_id").alias("component_id"), "node", "first")


def one_of_each(docs: DataFrame, find: Callable[..., DataFrame], **how) -> DataFrame:
    """The columns of docs, of each group of find() (near_duplicates() here or in jaccard.py) only the first document: smallest doc_id (null ids last), then the text's
    hash; of rows that are equal in both, one."""
    found = find(docs, **how)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    each = found.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), own.eqNullSafe(F.col("first")).alias("stays")).agg(F.count(F.lit(1)).alias("times"))
    # Most documents stay, and once: only the others are looked up.
    odd = written(each.where("NOT stays OR times > 1"), "simhash-odd")
    rows, names = packed(docs, doc_id="doc_id:long", text="text:string")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    met = rows.join(maybe_broadcast(odd, odd.count()), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left")
    again = met.where("stays").groupBy("i", "h").agg(F.first("row").alias("row"))
    return unpacked(met.where("stays IS NULL").select("row").unionByName(again.select("row")), names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_diff=2)
    return out.select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")
