"""Approximate nearest neighbours by collision counting with query-centred windows (C2LSH and QALSH; Gan et al., 2012, Huang et
al., 2015).

Each random projection keeps the vectors of a shard in a sorted array. A query opens a window around its own value in each; a
vector in the windows of many projections is probably near, and those over a threshold are verified by the exact product.
Windows then widen (virtual rehashing: the arrays stay): pointers move on to both sides, and only the entries that come in are
counted. This ends when the k-th best verified vector is within the radius that the windows stand for. The threshold lies Z
standard deviations below the expected count at that radius, so a true neighbour at that radius is verified with probability
0.93, nearer ones more often; if windows get to cover everything, all is verified.

Largest inner products become nearest distances by one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm of all.

Scale: vectors are dealt by hash to shards of about shard_rows. The stated queries meet every shard; behind a shard's rows,
sorted, they stream through the task that has built its arrays, so a task holds one shard and one batch of queries. Only from
block_rows queries on is a shard built again for the next block of them, so that tasks stay short; building is then under a
hundredth of a task. A shard gives k rows per query, and a query's lists merge by a ranking that Spark cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain, table, written

SHARD_ROWS = 20_000
BLOCK_ROWS = 30_000
PROJECTIONS = 128
Z = 1.5
#: The growth of the radius from round to round. The first one is the median distance of so many of a shard's vectors, evenly
#: spaced by vec_id, to their k-th neighbour there; it is where the search starts and has no part in where it ends.
GROWTH = 1.25
PROBES = 32
#: Vectors whose places are compared together.
BLOCK = 8192
SEED = 20
#: The probability that a standard normal number lies within one standard deviation.
P_WITHIN = 0.6826894921370859


class Shard:
    """The sorted projections of some vectors. k: of how many neighbours the typical distance sets the first radius."""

    def __init__(self, x: np.ndarray, most: float, k: int, projections: int = PROJECTIONS) -> None:
        self.x, self.most, self.m = x, most, projections
        n, scaled = len(x), x / most
        lift = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        self.axes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, projections))
        values = (np.column_stack([scaled, lift]) @ self.axes).T
        order = np.argsort(values, axis=1, kind="stable")
        # One flat sorted array: the values of projection j are moved by j times more than their whole range.
        self.shift = np.arange(projections) * 256.0
        self.flat = (np.clip(np.take_along_axis(values, order, 1), -100, 100) + self.shift[:, None]).ravel()
        self.rows = order.ravel().astype(np.int32)
        # Each vector's place in each array, in blocks of vectors that stay in a core's cache.
        place = np.empty((projections, n), np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(place, order, np.arange(n, dtype=place.dtype)[None, :], axis=1)
        self.place = [np.ascontiguousarray(place[:, i : i + BLOCK]) for i in range(0, n, BLOCK)]
        self.least = projections * P_WITHIN - Z * (projections * P_WITHIN * (1 - P_WITHIN)) ** 0.5
        some = np.linspace(0, n - 1, min(n, PROBES)).astype(int)
        kth = [-np.partition(-(x @ x[i]), min(k, n - 1))[min(k, n - 1)] for i in some]
        self.radius = float(np.median([self._distance(score, np.sqrt(x[i] @ x[i])) for i, score in zip(some, kth, strict=True)]))

    def _distance(self, score: float, norm: float) -> float:
        """Of a query scaled to norm 1 to a vector with this product, in the space with one more coordinate."""
        return float(np.sqrt(max(0.0, 2.0 - 2.0 * score / (self.most * norm))))

    def _first_counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many windows each vector is."""
        kind, out = self.place[0].dtype, []
        low, size = low.astype(kind)[:, None], (high - low).astype(kind)[:, None]
        for place in self.place:
            moved = place - low  # unsigned: places below the window become large
            out.append(np.less(moved, size).view(np.uint8).sum(axis=0, dtype=np.uint8 if self.m < 256 else np.int64))
        return np.concatenate(out).astype(np.int64)

    def search(self, q: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and exact products of the k best verified vectors (more with ties), and how many were verified; own: rows that
        don't count."""
        n, norm = len(self.x), float(np.sqrt((q * q).sum()))
        centre = np.clip((q / norm) @ self.axes[:-1], -100, 100) + self.shift
        seen = np.zeros(n, bool)
        seen[own] = True
        first, end = np.arange(self.m) * n, np.arange(1, self.m + 1) * n
        counts, verified, low, high = None, 0, None, None
        rows, scores, radius = np.empty(0, np.int64), np.empty(0), max(self.radius, 1e-9)
        while True:
            last = radius > 2.1  # no two points are farther apart than 2
            if not last:
                wide_low = np.maximum(np.searchsorted(self.flat, centre - radius, "left"), first)
                wide_high = np.maximum(np.minimum(np.searchsorted(self.flat, centre + radius, "right"), end), wide_low)
                if counts is None:
                    counts = self._first_counts(wide_low - first, wide_high - first)
                else:  # only what comes in
                    spans = zip(np.append(wide_low, high).tolist(), np.append(low, wide_high).tolist(), strict=True)
                    counts += np.bincount(np.concatenate([self.rows[a:b] for a, b in spans]), minlength=n)
                low, high = wide_low, wide_high
            new = np.flatnonzero(~seen if last else (counts >= self.least) & ~seen)
            if len(new):
                seen[new] = True
                verified += len(new)
                about = self.x[new] @ q
                if len(new) > 4 * k:  # products summed in the order of one row are for those that may be among the best
                    new = new[about >= np.partition(about, -k)[-k] - 1e-9 * self.most * norm]
                rows = np.append(rows, new)
                scores = np.append(scores, (self.x[new] * q).sum(axis=1))
                if len(rows) > 4 * k:
                    kth = np.partition(-scores, k - 1)[k - 1]
                    best = np.flatnonzero(-scores <= kth)
                    rows, scores = rows[best], scores[best]
            if last:
                return rows, scores, verified
            within = 3.0
            if len(rows) >= k:
                within = self._distance(-np.partition(-scores, k - 1)[k - 1], norm)
                if within <= radius:
                    return rows, scores, verified
            radius = min(radius * GROWTH, within * (1 + 1e-12) + 1e-12)


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Lists as rows of dim numbers; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), dim))
    x[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy()
    return x


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each vector whose vec_id is divisible by every, the k others with the largest inner
    products found, ties to the smaller vec_id. vectors: vec_id, embedding.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those without vec_id; shorter
    ones count as if zeros followed. Rows with one vec_id: each is a candidate of other queries; as a query they are one, by
    their smallest vector. Fewer than k candidates: all of them. No queries: no rows."""
    v = plain(vectors, vec_id="vec_id:long", e="embedding:array<double>")
    fine = "vec_id IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(e, x -> x <> 0)"
    v = written(v.where(fine), "vectors")
    n, dim, most, nq = v.agg(F.count(F.lit(1)), F.max(F.size("e")), F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not nq:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks, most = -(-n // shard_rows), -(-nq // block_rows), float(most) * (1 + 1e-12)
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = v.select(own(shards).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("is_query"), "vec_id", "e")
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("e").alias("e"))
    asked = asked.select(each(shards).alias("shard"), own(blocks).alias("block"), F.lit(True).alias("is_query"), "vec_id", "e")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, a shard's vectors before the queries."""
        at, gathered, index, ids = None, [], None, None
        for b in batches:
            numbers, kinds = b.column("part").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if a == e:
                    continue
                part = b.slice(a, e - a)
                if numbers[a] != at:
                    at, gathered, index = numbers[a], [], None
                if not kinds[a]:
                    gathered.append((part.column("vec_id").to_numpy(), _matrix(part.column("e"), dim)))
                    continue
                if not gathered:
                    continue  # a shard without vectors
                if index is None:
                    ids = np.concatenate([g[0] for g in gathered])
                    order = np.argsort(ids, kind="stable")
                    ids, index = ids[order], Shard(np.concatenate([g[1] for g in gathered])[order], most, k)
                    gathered = [(ids[:0], None)]
                out: list[list[np.ndarray]] = [[], [], []]
                for i, q in zip(part.column("vec_id").to_pylist(), _matrix(part.column("e"), dim), strict=True):
                    hit, scores, _ = index.search(q, k, np.arange(*np.searchsorted(ids, [i, i + 1])))
                    best = np.lexsort((ids[hit], -scores))[:k]
                    for column, value in zip(out, (np.full(len(best), i), ids[hit[best]], scores[best]), strict=True):
                        column.append(value)
                cat = [np.concatenate([np.empty(0, t), *c]) for c, t in zip(out, (np.int64, np.int64, float), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cat[0], pa.int64()), pa.array(cat[1], pa.int64()), pa.array(cat[2], pa.float64())], ["query_id", "vec_id", "score"])

    part = (F.col("shard") * blocks + F.col("block")).alias("part")
    dealt = data.unionByName(asked).select(part, "is_query", "vec_id", "e").repartition(int(shards * blocks), "part").sortWithinPartitions("part", "is_query")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
