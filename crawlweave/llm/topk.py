"""Exact top-k search with a KD-tree in each shard.

A shard is what one task reads, cut to a bounded number of vectors. Its tree splits the widest dimension at the median down to
small leaves and keeps tight boxes. A query visits nodes best-first by the greatest inner product that their box allows and stops
at its k-th score so far, which it carries from one shard of a task to the next. All tasks start from the k-th score of a first sample
of rows, a bound that the true k-th score is never below. Shards' lists are merged per query."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.runtime import written

#: Vectors of a shard's tree, of a leaf, and queries of one broadcast block (64 dimensions: 2 MB).
SHARD, LEAF, BLOCK = 65_536, 128, 16_384
#: Rows whose scores give every query its first bound.
FIRST = 2_048
#: Scores below this are exact as floats; larger ones are taken in 64-bit integers and end at the type's limits.
EXACT, LIMIT = float(1 << 52), float(1 << 63)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as long; beyond the type's range its least or greatest value."""
    about = rows.astype(np.float64) @ query.astype(np.float64)
    size = np.abs(rows.astype(np.float64)) @ np.abs(query.astype(np.float64))
    if not len(size) or size.max() < EXACT:
        return about.astype(np.int64)
    with np.errstate(over="ignore"):
        exact = rows @ query  # modulo 2**64, so right wherever the sum fits
    top = np.iinfo(np.int64)
    return np.where(about >= LIMIT, top.max, np.where(about < -LIMIT, top.min, exact))


class Tree:
    """Median splits by position, so equal vectors never stop it. Node i has rows begin[i]:end[i] and children 2i+1 and 2i+2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.spans: dict[int, tuple[int, int]] = {}
        todo = [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            self.spans[node] = (a, b)
            if b - a > leaf:
                own = vectors[order[a:b]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                todo += [(2 * node + 1, a, a + half), (2 * node + 2, a + half, b)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes = sorted(self.spans)
        self.place = {n: i for i, n in enumerate(self.nodes)}
        self.low = np.stack([self.vectors[a:b].min(axis=0) for a, b in map(self.spans.get, self.nodes)]).astype(np.float64)
        self.high = np.stack([self.vectors[a:b].max(axis=0) for a, b in map(self.spans.get, self.nodes)]).astype(np.float64)
        self.floats = self.vectors.astype(np.float64) if not len(ids) or np.abs(self.vectors.astype(np.float64)).max() < 1 << 20 else None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """At least the greatest inner product of each query with any point of each box."""
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        out = up @ self.high.T + down @ self.low.T
        size = up @ np.abs(self.high).T - down @ np.abs(self.low).T
        return out + np.where(size < EXACT, 0, size * 1e-9)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], k: int, least: int = -(1 << 63)) -> None:
        """Improves best, a heap of (score, -id) whose top is the k-th. Rows that score below `least` can't be among the k."""
        heap = [(-bound[0], 0)]
        small = self.floats is not None and np.abs(query).max(initial=0) < 1 << 20
        asked = query.astype(np.float64) if small else query
        while heap:
            most, node = heapq.heappop(heap)
            floor = max(least, best[0][0]) if len(best) == k else least
            if -most < floor:
                return  # an equal bound is visited: it may hold a smaller id
            a, b = self.spans[node]
            if 2 * node + 1 in self.place:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(heap, (-bound[self.place[child]], child))
                continue
            scores = self.floats[a:b] @ asked if small else products(self.vectors[a:b], asked)
            good = np.flatnonzero((self.ids[a:b] != own) & (scores >= floor))
            if len(good) > k:
                cut = np.partition(scores[good], len(good) - k)[len(good) - k]
                good = good[scores[good] >= cut]
                good = good[np.lexsort((self.ids[a:b][good], -scores[good]))][:k]
            for i in good.tolist():
                item = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def first_bounds(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among a sample of rows of other ids, which the k-th of all rows is never below."""
    out = np.full(len(ids), -(1 << 63), np.int64)
    if len(sample) and max(np.abs(queries).max(initial=0), np.abs(sample).max(initial=0)) < 1 << 20:
        for a in range(0, len(ids), 1024):
            scores = queries[a : a + 1024].astype(np.float64) @ sample.T.astype(np.float64)
            scores[ids[a : a + 1024, None] == others[None, :]] = -np.inf
            if len(sample) >= k:
                kth = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
                out[a : a + 1024] = np.where(np.isfinite(kth), kth, out[a : a + 1024]).astype(np.int64)
    return out


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long; vectors that are null or hold null, NaN or infinite components are left out."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(whole).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query with vectors of other ids, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; vectors of another length than the query's take no part for it. Rows that repeat
    a vec_id are candidates each for itself; a query that repeats counts once, with its least vector. Fewer candidates than k give
    fewer rows; an empty table gives none. Scores beyond 64 bits stand as the type's least or greatest value, and so do components.
    Other columns are not read. Queries are taken in blocks of bounded size, each against all rows; where there are several blocks,
    each one's result is written before the next."""
    spark = vectors.sparkSession
    asked = quantized(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:
        asked = written(asked, "queries")
    rows = quantized(vectors, scale)
    some = rows.limit(FIRST).toArrow()
    parts = []
    for part in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).toArrow()  # about one block
        shapes = {}
        for d, at in _by_length(own):
            ids, values = own.column("vec_id").to_numpy()[at], _matrix(own, at, d)
            near = dict(_by_length(some)).get(d, np.zeros(0, np.int64))
            shapes[d] = (ids, values, first_bounds(ids, values, some.column("vec_id").to_numpy()[near], _matrix(some, near, d), k))
        sent = spark.sparkContext.broadcast(shapes)
        found = rows.mapInArrow(_searched(sent, k, shard), "query_id long, vec_id long, score long")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            parts.append(written(found, "top-k").written_at)
            sent.unpersist()
    return spark.read.schema(found.schema).parquet(*parts) if parts else found


def _by_length(t: pa.Table) -> list[tuple[int, np.ndarray]]:
    """Lengths of vectors in column v and the rows that have them."""
    size = pc.list_value_length(t.column("v")).to_numpy()
    return [(int(d), np.flatnonzero(size == d)) for d in np.unique(size)]


def _matrix(t: pa.Table | pa.RecordBatch, at: np.ndarray, d: int) -> np.ndarray:
    """Rows `at`, all of length d, of the list column v."""
    lists = t.column("v").take(pa.array(at))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(at), d)


def _searched(sent, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {int(q): [] for own, _, _ in sent.value.values() for q in own}
        held: dict[int, tuple[list, list]] = {}

        def search(d: int) -> None:
            vec, data = held.pop(d)
            tree = Tree(np.concatenate(vec), np.concatenate(data))
            own, q, least = sent.value[d]
            for a in range(0, len(own), 64):
                for query, name, low, bound in zip(q[a : a + 64], own[a : a + 64].tolist(), least[a : a + 64].tolist(), tree.bounds(q[a : a + 64]), strict=True):
                    tree.search(query, name, bound, best[name], k, low)

        for batch in batches:
            for d, at in _by_length(batch):
                if d in sent.value:
                    vec, data = held.setdefault(d, ([], []))
                    vec.append(batch.column(0).to_numpy()[at])
                    data.append(_matrix(batch, at, d))
                    if sum(map(len, vec)) >= shard:
                        search(d)
        for d in list(held):
            search(d)
        rows = [(q, -v, s) for q, heap in best.items() for s, v in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run
