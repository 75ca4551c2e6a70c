"""Near-duplicates at a Jaccard similarity: the SimHash index first, then an exact way for what fingerprints can't promise.

Pairs whose fingerprints the index of simhash.py finds near are verified by their whole shingle sets; they are most near copies.
But no number of differing bits is a bound for a similarity: sets of similarity 0.8 differ in 15 % of the bits on average, some
in many more, so an index over bytes has no guaranteed count there. The rest is found by a prefix filter over the shingles themselves,
another inverted index with a guaranteed count, and complete:

A set of n shingles that is similar to another shares at least ceil(similarity * n) of its shingles with it, so in any order that
holds for all sets the first n - ceil(similarity * n) + 1 of both have a shingle in common: whoever is similar meets in a list of
such a prefix. Sizes and positions in the prefixes rule out further pairs, then odd sketches do (all three bounds are exact), and the
whole sets of the others are compared. Shingles are known by 64-bit hashes.

An odd sketch (Mitzenmacher et al., 2014) has a bit for each residue of the hashes: whether an odd number of the set's shingles has it. Each
bit that differs needs a shingle that only one of two sets has, so the differing bits are no more than these shingles.

Scale: the order puts shingles that are frequent in a sample last, so that common passages make no long lists; the sample has no
part in the result. Equal sets are one node. A list is first compared with single ones of its nodes, which makes one component of
many alike; then only nodes of different components are compared. Pairs that have a shingle in common by chance grow with the square
of the input: of these only sketches are shuffled, about a 60th of the sets, and whole sets only of the pairs that sketches leave.
Both go in passes of a bounded number of pairs. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, maybe_broadcast, plain, written
from .components import components
from .simhash import fingerprint_of, hash_blocks
from .simhash import links as fingerprint_links

#: Documents of the sample, and how many of its most frequent shingles count as frequent, from so many documents on.
SAMPLE, FREQUENT, LEAST = 20_000, 50_000, 3
#: Rounds in which a list is compared with one of its nodes, another one each time, before the rest is compared in pairs.
HUBS = 1
#: Passes over the pairs to compare, by their second node: at least so many, and more where one would have more pairs than this. Each
#: shuffles such a part of the sets of all pairs, which bounds the disk. Pairs of a pass over sketches at most.
PASSES, SET_PAIRS, SKETCH_PAIRS = 2, 200_000, 20_000_000
#: Bits of an odd sketch for each shingle, at least; twice as many at most.
SKETCH_BITS = 0.75


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles of a text as signed 64-bit hashes in ascending order; no words: none."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hash_blocks(text, shingle)])).view(np.int64)


def _node(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 1)).astype(np.int64))


def prefix(s: np.ndarray, similarity: float, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of s of which a similar set's prefix has one: those that are not in often (ascending) first, then by times."""
    least = ceil(similarity * len(s) - 1e-9)
    rank = np.zeros(len(s), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        rank = np.where(often[at] == s, times[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - least + 1]] if len(s) else s


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The odd sketch of a set as signed 64-bit words, a power of two of them that grows with the set."""
    words = 1 << max(0, ceil(len(s) * SKETCH_BITS / 64) - 1).bit_length()
    odd = np.bincount((s.view(np.uint64) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """For each row: the bits in which the sketches a and b differ, the longer one folded to the length of the other."""
    sides = [(np.asarray(x.values).view(np.uint64), np.asarray(x.offsets).astype(np.int64)) for x in (a, b)]
    sizes = np.stack([np.diff(at) for _, at in sides], axis=1)
    out = np.zeros(len(sizes), np.int64)
    for size in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == size).all(axis=1))
        least = int(size.min())
        for some in np.array_split(rows, ceil(len(rows) * int(size.max()) / (1 << 20))):
            # A residue to a smaller power of two is the residue of the residue, so parts of a sketch add up to the smaller sketch.
            x, y = (np.bitwise_xor.reduce(v[at[some][:, None] + np.arange(k)].reshape(len(some), -1, least), axis=1) for (v, at), k in zip(sides, size, strict=True))
            out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, ascending, and in how many of its documents."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle))], ["h"])

    top = some.select("text").mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST)
    top = sorted((r.h, r.c) for r in top.orderBy(F.desc("c"), "h").limit(FREQUENT).collect())
    return np.array([h for h, _ in top], np.int64), np.array([c for _, c in top], np.int64)


def with_prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, node (the same for equal sets), n: size of the set, sig: fingerprint, prefix, odd: sketch. docs: doc_id, text."""
    often, times = _frequent(docs, shingle)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, sig, first, odd = [], [], [], [], []
            for t in b.column("text"):
                hashes = [*hash_blocks(t.as_py(), shingle)]
                s = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes])).view(np.int64)
                sig.append(fingerprint_of(hashes))
                node.append(_node(s))
                n.append(len(s))
                first.append(prefix(s, similarity, often, times))
                odd.append(odd_sketch(s))
            lists = pa.list_(pa.int64())
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(first, lists), pa.array(odd, lists)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "node", "n", "sig", "prefix", "odd"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(each, "doc_id long, text_hash long, node long, n int, sig binary, prefix array<long>, odd array<long>")


def _passes(pairs: DataFrame, most: int, least: int = 1) -> list[Column]:
    """Conditions on b that deal pairs (a, b) out to passes of about `most` pairs, `least` passes at least."""
    n = max(least, ceil(pairs.count() / most))
    return [F.pmod(F.xxhash64("b"), F.lit(n)) == k for k in range(n)]


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) that sizes and sketches don't rule out. nodes: node, n, odd."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.asarray(b.column("n")).astype(np.int64) + np.asarray(b.column("m"))
            least = np.minimum(np.asarray(b.column("n")), np.asarray(b.column("m")))
            c = np.minimum((both - differing(b.column("odd"), b.column("other"))) // 2, least)
            yield b.select(["a", "b"]).filter(pa.array(c >= similarity * (both - c) - 1e-9))

    found = []
    for mine in _passes(pairs, SKETCH_PAIRS):
        some = pairs.where(mine)
        other = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("odd").alias("other")).where(mine)
        both = nodes.select(F.col("node").alias("a"), "n", "odd").join(maybe_broadcast(some, some.count()), "a").join(other, "b")
        found.append(written(both.mapInArrow(each, "a long, b long"), "jaccard-likely"))
    return reduce(DataFrame.union, found)


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose whole sets have the similarity. docs: doc_id, text; nodes: node, first, n, odd."""
    pairs = likely(pairs, nodes, similarity)
    want = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    want = written(nodes.join(want, F.col("node") == F.col("w"), "left_semi").select(F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h")), "jaccard-want")
    # Texts are looked up by as many broadcasts as it takes: to shuffle them would cost more than to read them again.
    n = max(1, ceil(want.count() / BROADCAST_ROWS))
    parts = [F.broadcast(want.where(F.pmod("h", F.lit(n)) == k)) for k in range(n)]
    owners = [docs.withColumn("text_hash", F.xxhash64("text")).join(part, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi") for part in parts]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                s = shingle_set(t.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s)], pa.int64()), pa.array([s], pa.list_(pa.int64()))], ["node", "s"])

    sets = reduce(DataFrame.union, owners).select("text").mapInArrow(each, "node long, s array<long>")
    sets = written(sets.groupBy("node").agg(F.first("s").alias("s")), "jaccard-sets")
    found = []
    for mine in _passes(pairs, SET_PAIRS, PASSES):
        some = pairs.where(mine)
        other = sets.select(F.col("node").alias("b"), F.col("s").alias("t")).where(mine)
        both = sets.select(F.col("node").alias("a"), "s").join(maybe_broadcast(some, some.count()), "a").join(other, "b")
        both = both.select("a", "b", F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("c"))
        found.append(written(both.where(F.col("c") / (F.col("n") + F.col("m") - F.col("c")) >= similarity).select("a", "b"), "jaccard-links"))
    out = reduce(DataFrame.union, found)
    dropped(want, sets)
    return out


def near_fingerprints(nodes: DataFrame, max_diff: int) -> DataFrame:
    """a, b: edges whose components are those of all nodes whose fingerprints differ in max_diff bits at most. nodes: node, sig."""
    each = nodes.select("node", "sig", F.min("node").over(Window.partitionBy("sig")).alias("low"))
    same = each.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return same.union(fingerprint_links(each.where("node = low").select("node", "sig"), 8, max_diff))


def _lists(nodes: DataFrame) -> DataFrame:
    """The inverted index, lists of two nodes at least: key, node, n, p (place in the prefix), root (the component that a node is known to
    be in so far), used, size. nodes: node, n, prefix, each node once."""
    key = Window.partitionBy("key")
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("p", "key"))
    lists = rows.withColumn("last", F.max("node").over(key)).withColumn("low", F.min("node").over(key)).where("low <> last")
    lists = lists.withColumn("size", F.count(F.lit(1)).over(key))
    return written(lists.select("key", "node", "n", "p", F.col("node").alias("root"), F.lit(False).alias("used"), "size"), "jaccard-lists")


def links(docs: DataFrame, nodes: DataFrame, lists: DataFrame, shingle: int, similarity: float, max_diff: int) -> DataFrame:
    """node, root: components of the graph of all pairs of similar nodes. nodes: node, sig, first, n, odd, each node once; lists: as of
    _lists(), dropped here."""
    able = f"""least(n, m) >= {similarity!r} * greatest(n, m) - 1e-9
      AND 1 + least(n - 1 - p, m - 1 - q) >= {similarity!r} / (1 + {similarity!r}) * (n + m) - 1e-9"""
    key = Window.partitionBy("key")
    tried = found = None
    for k in range(HUBS):
        # The hub is the node that meets most others: the text of which others are copies, rather than one of these.
        meets = written(lists.groupBy(F.col("node").alias("c")).agg(F.sum("size").alias("meets")), "jaccard-meets")
        hub = F.max(F.struct(~F.col("used"), "meets", "node", "n", "p", "root")).over(key)
        at_hub = written(lists.join(maybe_broadcast(meets, meets.count()), F.col("node") == F.col("c")).drop("c", "size").withColumn("hub", hub).drop("meets"), "jaccard-hubs")
        dropped(meets, lists)
        near = at_hub.withColumn("m", F.col("hub.n")).withColumn("q", F.col("hub.p")).where(f"root <> hub.root AND {able}")
        near = near.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
        if k == 0:
            prints = near_fingerprints(nodes, max_diff)
            near = near.union(prints.select(F.least("a", "b"), F.greatest("a", "b")))
        pairs = near.distinct() if tried is None else near.distinct().join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        links = _similar(pairs, docs, nodes, shingle, similarity)
        tried, found = (pairs, links) if tried is None else (tried.union(pairs), found.union(links))
        lists = _apart(at_hub.withColumn("used", F.col("used") | (F.col("node") == F.col("hub.node"))).drop("hub"), components(found), key)
        dropped(at_hub)
    # What is still apart: all pairs of a list that are in different components.
    other = lists.select(F.col("key").alias("k"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("root").alias("root_b"))
    rest = lists.join(other, (F.col("key") == F.col("k")) & (F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & F.expr(able))
    rest = written(rest.select(F.col("node").alias("a"), "b").distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    out = components(found.union(_similar(rest, docs, nodes, shingle, similarity)))
    dropped(lists, rest)
    return out


def _apart(lists: DataFrame, near: DataFrame, key: WindowSpec) -> DataFrame:
    """The lists that still have several components, with these. near: node, root."""
    near = written(near.select(F.col("node").alias("r"), F.col("root").alias("now")), "jaccard-near")
    rows = lists.join(maybe_broadcast(near, near.count()), F.col("node") == F.col("r"), "left").select("key", "node", "n", "p", F.coalesce("now", "root").alias("root"), "used")
    rows = rows.withColumn("low", F.min("root").over(key)).withColumn("high", F.max("root").over(key)).withColumn("size", F.count(F.lit(1)).over(key)).where("low <> high").drop("low", "high")
    out = written(rows, "jaccard-apart")
    dropped(near)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, max_diff: int = 2) -> DataFrame:
    """One row per document: doc_id, text_hash, component_id (the smallest doc_id of those reachable over pairs whose shingle sets
    have this Jaccard similarity or more), node (the group's own key), first (as in simhash.near_duplicates).

    A-Z are lower-cased; fewer words than a shingle has: their whole sequence is the shingle. Texts without words (also null ones)
    are alike. max_diff: bits in which 64-bit fingerprints differ at most that the first index links; it has no part in the result.
    Null ids as in simhash.near_duplicates. No rows: no rows."""
    docs = plain(docs, doc_id="doc_id:long", text="text:string")
    sets = written(with_prefixes(docs, shingle, similarity), "jaccard-prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = written(sets.groupBy("node").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd")), "jaccard-nodes")
    # The prefixes are the bulk of these tables: each is kept only until it has been read.
    whole, sets = sets, written(sets.select("doc_id", "text_hash", "node"), "jaccard-members")
    dropped(whole)
    lists = _lists(nodes)
    whole, nodes = nodes, written(nodes.select("node", "sig", "first", "n", "odd"), "jaccard-heads")
    dropped(whole)
    found = links(docs, nodes, lists, shingle, similarity, max_diff).withColumnRenamed("node", "r")
    placed = written(nodes.select("node", "first").join(found, F.col("node") == F.col("r"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "jaccard-placed")
    dropped(nodes)
    groups = placed.groupBy("root").agg(F.min("first").alias("first"))
    placed = placed.select(F.col("node").alias("r"), "root").join(groups, "root")
    return sets.join(placed, F.col("node") == F.col("r")).select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), F.col("root").alias("node"), "first")
