"""Exact top-k inner products by no-random-access aggregation.

Each block of candidates has its components in sorted lists, one per dimension, sorted once. For a query the lists
are read side by side, each from the end that the query's sign makes best and down to one common contribution, in
a few steps. What is read so far gives every candidate a lower and an upper score bound, and each step adds only
what it reads. Reading stops when no candidate outside a few can reach the kth lower bound; the scores of those few
are resolved from their components.

A first search over a slice of the candidates gives each query a floor, which all tasks start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.staging import staged

#: Components of a block's candidates, queries whose reading depths are looked up together, queries sent to the executors at once
#: (64 dimensions: 16 MB), candidates of the first slice, about.
BLOCK, GROUP, CHUNK, SLICE = 1 << 20, 256, 32_768, 4096
#: Sums below half of it are read together with the number of their parts; both fit a double's 53 bits.
PACKED = 2.0**32
#: Shares of all entries that have been read, about, after each step.
STEPS = (0.125, 0.25, 0.375, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0)


class Lists:
    """A block's sorted lists: ``order[d]`` names the candidates by falling component d, ``value[d]`` holds these.

    ``entries`` counts what has been read of them, of ``n * dims`` for each query.
    """

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        self.x = x
        self.order = np.argsort(-x, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(x.T, self.order, 1)
        self.rising = self.value[:, ::-1].copy()
        self.most = np.abs(x).max(initial=0)
        #: What a step reads, at most; held, as memory that is new each time costs more than reading.
        self.room = np.empty(x.size, np.intp), np.empty(x.size)
        self.entries = 0

    def depths(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(thresholds, depths): for each query and step the common contribution, and how many entries of each list reach it."""
        some = self.x[:: max(1, self.n // 32)]
        sample = (queries[:, None, :] * some[None]).reshape(len(queries), -1)
        theta = np.floor(np.quantile(sample, 1 - np.array(STEPS), axis=1).T)
        depth = np.empty((len(queries), len(STEPS), self.dims), np.int64)
        for d in range(self.dims):
            q = queries[:, d, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                at_least = self.n - np.searchsorted(self.rising[d], theta / q, "left")
                at_most = np.searchsorted(self.rising[d], theta / q, "right")
            depth[:, :, d] = np.where(q > 0, at_least, np.where(q < 0, at_most, np.where(theta <= 0, self.n, 0)))
        depth[:, -1] = self.n
        return theta, np.maximum.accumulate(depth, axis=1)

    def read(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the entries from depth a to depth b of each list add: (sum of contributions, number of entries) by candidate."""
        ids, parts, at = *self.room, 0
        for d, (v, a_, b_) in enumerate(zip(q.tolist(), a.tolist(), b.tolist(), strict=True)):
            if b_ > a_:
                begin, end, to = *((a_, b_) if v > 0 else (self.n - b_, self.n - a_)), at + b_ - a_
                ids[at:to] = self.order[d, begin:end]
                np.multiply(self.value[d, begin:end], v, out=parts[at:to])
                at = to
        if not at:
            return np.zeros(self.n), np.zeros(self.n, np.int64)
        ids, parts = ids[:at], parts[:at]
        self.entries += at
        if self.most * np.abs(q).max() * self.dims < PACKED / 2 and self.dims < 2**20:
            # sums of whole numbers and their numbers in one pass: each is the other's rest by PACKED
            parts += PACKED
            both = np.bincount(ids, parts, self.n)
            count = np.rint(both / PACKED)
            return both - count * PACKED, count.astype(np.int64)
        return np.bincount(ids, parts, self.n), np.bincount(ids, minlength=self.n)

    def search(self, q: np.ndarray, theta: np.ndarray, depth: np.ndarray, floor: float, k: int, own: np.ndarray) -> np.ndarray:
        """Candidates that may be among the k best and reach ``floor``; ``own`` ones take no part."""
        seen, count, before = np.zeros(self.n), np.zeros(self.n, np.int64), np.zeros(self.dims, np.int64)
        worst = np.minimum(self.value[:, 0] * q, self.value[:, -1] * q).min()
        # sums of whole numbers are exact below 2**53; beyond, bounds give way by their rounding
        slack = 1e-12 * float(np.abs(q) @ np.maximum(np.abs(self.value[:, 0]), np.abs(self.value[:, -1])))
        for step in range(len(theta)):
            more, entries = self.read(q, before, depth[step])
            seen += more
            count += entries
            before = depth[step]
            hidden = self.dims - count
            lower = seen + hidden * worst
            lower[own] = -np.inf
            if self.n > k:
                floor = max(floor, float(np.partition(lower, self.n - k)[self.n - k]))
            # a hidden entry of any list contributes no more than the threshold that all lists have been read down to
            qualified = seen + hidden * theta[step] >= floor - slack
            qualified[own] = False
            able = np.flatnonzero(qualified)
            left = depth[step + 1].sum() - before.sum() if step + 1 < len(theta) else 0
            if len(able) <= k or len(able) * self.dims <= left:
                break
        return able


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; in Python's integers where 64 bits might not hold them."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2.0**53:
        return x.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], object)


def _largest(score: np.ndarray, names: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, name) of the k largest scores and all that equal the kth."""
    if len(score) > k and score.dtype != object:
        kept = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, names = score[kept], names[kept]
    return [(-int(v), int(c)) for v, c in zip(score, names, strict=True)]


def _matrix(lists, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows, ``rows`` at a time: lists are worth their reading when they are long, and Spark's batches may be short."""
    held, waiting = [], 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        while waiting >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held = table.slice(rows).to_batches()
            waiting -= rows
    if waiting:
        yield pa.Table.from_batches(held)


def _top_of_chunk(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """Each task's k best candidates that reach the query's floor; the queries are at most CHUNK or so."""
    dims = queries.shape[1]

    def run(batches):
        floor, best = floors.copy(), [[] for _ in ids]
        for part in _blocks(batches, max(1, BLOCK // max(1, dims))):
            names = part.column("vec_id").to_numpy()
            lists = Lists(_matrix(part.column("x").to_pylist(), dims))
            for g in range(0, len(ids), GROUP):
                theta, depth = lists.depths(queries[g : g + GROUP])
                for q in range(g, min(g + GROUP, len(ids))):
                    found = lists.search(queries[q], theta[q - g], depth[q - g], floor[q], k, np.flatnonzero(names == ids[q]))
                    if len(found):
                        score = _exact(lists.x[found], queries[q])
                        best[q] = sorted([*best[q], *_largest(score, names[found], k)])[:k]
                        if len(best[q]) == k:
                            floor[q] = max(floor[q], float(-best[q][-1][0]))
        rows = [(q, int(ids[q]), c, -s) for q, kept in enumerate(best) for s, c in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["asked", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "asked long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, query: F.Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, embedding)`` where ``query`` holds, its k best other rows.

    Components count as floor(scale * x); score is their integer inner product, exact at any size (one over 64 bits
    is an error); ties go to the smaller vec_id; fewer rows than k give all. Vectors that are null or hold null, NaN
    or infinite components, and rows with a null vec_id, take no part. A shorter vector counts as followed by
    zeros, an empty one as zeros. Of rows with the same vec_id and vector one counts; different vectors under one
    vec_id are different candidates, none of them for a query of that vec_id. Other columns are ignored. An empty
    table, or no query, gives an empty table.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: F.floor(scale * v.cast("double")).cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), query.alias("asks"))
    valid = staged(valid.dropDuplicates(["vec_id", "x"]))
    size = valid.agg(F.max(F.size("x")), F.count(F.when(F.col("asks"), 1)), F.count("*")).first()
    dims, many, rows = size[0] or 0, size[1], size[2]
    chunks = -(-many // CHUNK)
    # hashed to twice as many chunks as there must be, so that none is over CHUNK
    chunks = 2 * chunks if chunks > 1 else chunks
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, chunks)))
    candidates = valid.select("vec_id", "x")
    slice_ = candidates.where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(max(1, rows // SLICE))) == 0)
    parts = []
    for c in range(chunks):
        asked = valid.where("asks").where(chunk == c).orderBy("vec_id").select("vec_id", "x").toPandas()
        if len(asked):
            ids, queries = asked["vec_id"].to_numpy(np.int64), _matrix(asked["x"], dims)
            floors = np.full(len(ids), -np.inf)
            if rows > 2 * SLICE:  # one number for each query of the chunk
                first = _ranked(_top_of_chunk(slice_, ids, queries, floors, k), k).where(F.col("rank") == k).select("asked", "score").toPandas()
                floors[first["asked"].to_numpy(np.int64)] = first["score"].to_numpy(float)
            part = _ranked(_top_of_chunk(candidates, ids, queries, floors, k), k).select("query_id", "rank", "vec_id", "score")
            parts.append(staged(part) if chunks > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*(p._staged_at for p in parts))
