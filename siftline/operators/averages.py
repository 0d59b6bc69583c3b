"""Means of the rows within reach of moving points, without a row for each pair.

Rows that lie close, by the leaves of ``neighbours``, are packed into blocks of bounded size, one table row each. A block's
points move together: in a step the pieces of all rows whose boxes are within reach of the block's come to it one after the
other, and numpy adds up what each point reaches. Every pair that a box doesn't settle is still compared, so a job whose
rows are nearly all in reach of each other costs the square of its different rows, over bounded tables of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.neighbours import Leaves, Tree

#: Rows of a block at least and at most, about, and blocks for each core where rows are few; rows of a piece; points of a block that share a box.
BLOCK_LEAST, BLOCK_MOST, BLOCKS_A_CORE, PIECE_ROWS, CHUNK_ROWS = 1024, 8192, 4, 512, 256
_BOX = "low array<double>, high array<double>"
_BLOCK = f"job_id long, block long, rows binary, x binary, {_BOX}"


def finite(dims: int) -> Column:
    """Whether a0, ... are all finite: other rows are in reach of none."""
    return reduce(lambda a, b: a & b, (F.abs(f"a{d}") < float("inf") for d in range(dims)))


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """(job_id, block, rows, x, low, high): the finite ``rows`` (job_id, row_id, a0, ...) in blocks, with their boxes."""
    names = [f"a{d}" for d in range(dims)]
    fine = rows.where(finite(dims))
    leaves = Leaves(fine, dims)
    total, cores = sum(int(t.rows.sum()) for t in leaves.trees.values()), rows.sparkSession.sparkContext.defaultParallelism
    size = min(BLOCK_MOST, max(BLOCK_LEAST, total // (BLOCKS_A_CORE * cores)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "row_id"], kind="stable")
        return pd.DataFrame([_block(pdf["job_id"].iloc[0], pdf["block"].iloc[0], pdf["row_id"].to_numpy(np.int64).tobytes(), pdf[names].to_numpy(float))])

    return leaves.blocked(fine, names, "row_id", size).groupBy("job_id", "block").applyInPandas(pack, _BLOCK)


def _block(job: int, block: int, rows: bytes, x: np.ndarray) -> dict:
    return {"job_id": job, "block": block, "rows": rows, "x": x.tobytes(), "low": x.min(0).tolist(), "high": x.max(0).tolist()}


def unpacked(blocks: DataFrame, dims: int) -> DataFrame:
    """(job_id, row_id, a0, ...) of all rows of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, rows, x in zip(*(batch.column(n).to_pylist() for n in ("job_id", "rows", "x")), strict=True):
                ids, x = np.frombuffer(rows, np.int64), np.frombuffer(x).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), job)), pa.array(ids), *(pa.array(x[:, d].copy()) for d in range(dims))], ["job_id", "row_id", *(f"a{d}" for d in range(dims))])

    return blocks.select("job_id", "rows", "x").mapInArrow(run, "job_id long, row_id long, " + ", ".join(f"a{d} double" for d in range(dims)))


def pieces(blocks: DataFrame, dims: int) -> DataFrame:
    """(job_id, piece, y, w, low, high): the different rows of each block, some at a time, with how often each is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job, block, x in zip(pdf["job_id"], pdf["block"], pdf["x"], strict=True):
                _, first, times = np.unique(x := np.frombuffer(x).reshape(-1, dims), axis=0, return_index=True, return_counts=True)
                order = np.argsort(first)
                y, w = x[first[order]], times[order].astype(float)
                parts = [(y[s : s + PIECE_ROWS], w[s : s + PIECE_ROWS]) for s in range(0, len(y), PIECE_ROWS)]
                yield pd.DataFrame([{"job_id": job, "piece": block << 32 | i, "y": y.tobytes(), "w": w.tobytes(), "low": y.min(0).tolist(), "high": y.max(0).tolist()} for i, (y, w) in enumerate(parts)])

    return blocks.select("job_id", "block", "x").mapInPandas(run, f"job_id long, piece long, y binary, w binary, {_BOX}")


class Sums:
    """Weights, and sums of ``y`` by weight, of what is within ``reach`` of each of ``x``, by pieces of y."""

    def __init__(self, x: np.ndarray, reach: float):
        self.x, self.reach, self.fine = x, reach, np.isfinite(x).all(1)
        some, back = np.unique(x[self.fine], axis=0, return_inverse=True)
        leaf = Tree.built(some, CHUNK_ROWS).leaf(some)
        order = np.argsort(leaf, kind="stable")
        some, self.back = some[order], np.argsort(order)[back.ravel()]
        ends = np.cumsum(np.bincount(leaf)).tolist()
        self.chunks = [(slice(s, e), some[s:e], some[s:e].min(0), some[s:e].max(0)) for s, e in zip([0, *ends], ends, strict=False)]
        self.held = np.zeros((len(some), x.shape[1] + 1))
        # tables of pairs are made in the same place each time
        self.spare = [np.empty(CHUNK_ROWS * PIECE_ROWS, t) for t in (np.float32, bool, bool, float)]

    def add(self, y: np.ndarray, w: np.ndarray) -> None:
        far, across = self.reach * self.reach, y.T.copy()
        both = np.concatenate([y * w[:, None], w[:, None]], 1)
        for own, x, low, high in self.chunks:
            # out of reach of the chunk's box, or within reach of all of it
            over, under = across - low[:, None], high[:, None] - across
            gap, span = np.maximum(-np.minimum(over, under), 0.0), np.maximum(over, under)
            near = (gap * gap).sum(0) <= far * (1 + 1e-9)
            if not near.any():
                continue
            whole = (span * span).sum(0) <= far * (1 - 1e-9)
            if whole.any():
                self.held[own] += both[whole].sum(0)
            rest = np.flatnonzero(near & ~whole)
            if len(rest):
                inside = self.reached(x, y[rest], (low + high) / 2)
                ones = self.spare[3][: inside.size].reshape(inside.shape)
                np.copyto(ones, inside)
                self.held[own] += ones @ both[rest]

    def reached(self, x: np.ndarray, y: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Which of y each of x reaches: by a product in single precision, and by the differences where that is too close to say."""
        apart, inside, unsure = (spare[: len(x) * len(y)].reshape(len(x), len(y)) for spare in self.spare[:3])
        with np.errstate(all="ignore"):
            a, b = (x - middle) / self.reach, (y - middle) / self.reach
            aa, bb = (a * a).sum(1, keepdims=True), (b * b).sum(1, keepdims=True)
            left, right = np.concatenate([a, aa, np.ones_like(aa)], 1), np.concatenate([-2 * b, np.ones_like(bb), bb], 1)
            np.matmul(left.astype(np.float32), right.astype(np.float32).T, out=apart)
            error = 4e-6 * (aa.max() + bb.max() + 1)
            np.less_equal(apart, np.float32(1 - error), out=inside)
            np.greater(apart, np.float32(1 + error), out=unsure)
        np.logical_not(np.logical_or(inside, unsure, out=unsure), out=unsure)
        if unsure.any():
            i, j = np.divmod(np.flatnonzero(unsure), len(y))
            far = sum(((x[i, d] - y[j, d]) ** 2 for d in range(x.shape[1])), np.zeros(len(i)))
            inside[i, j] = far <= self.reach * self.reach
        return inside

    def means(self) -> np.ndarray:
        """The mean that each of x moves to, as a float; one that reaches nothing stays."""
        w, out = self.held[self.back, -1:], self.x.copy()
        with np.errstate(all="ignore"):
            mean = (self.held[self.back, :-1] / w).astype(np.float32).astype(float)
        out[self.fine] = np.where(w > 0, mean, out[self.fine])
        return out


def moved(blocks: DataFrame, parts: DataFrame, dims: int, reach: float, tasks: int) -> DataFrame:
    """``blocks``, dealt into ``tasks``, whose points are the means of the rows of ``parts`` within reach of each."""
    boxes = blocks.select("job_id", "block", F.col("low").alias("_low"), F.col("high").alias("_high"))
    gap = lambda d: F.greatest(F.col("_low")[d] - F.col("high")[d], F.col("low")[d] - F.col("_high")[d], F.lit(0.0))
    apart = sum((gap(d) * gap(d) for d in range(dims)), F.lit(0.0))
    # a block is thousands of rows, so the boxes are few
    met = parts.join(F.broadcast(boxes), "job_id").where(apart <= reach * reach * (1 + 1e-9)).select("job_id", "block", "piece", "y", "w")
    own = blocks.select("job_id", "block", F.lit(-1).cast("long").alias("piece"), F.col("x").alias("y"), F.col("rows").alias("w"))
    dealt = own.unionByName(met).repartitionById(tasks, F.col("block").cast("int")).sortWithinPartitions("block", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sums = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(*block, sums.means())], schema)

        for batch in batches:
            for job, number, piece, y, w in zip(*(batch.column(n) for n in ("job_id", "block", "piece", "y", "w")), strict=True):
                x = np.frombuffer(y.as_buffer()).reshape(-1, dims)
                if piece.as_py() >= 0:
                    sums.add(x, np.frombuffer(w.as_buffer()))
                    continue
                if block:
                    yield done()
                block, sums = (job.as_py(), number.as_py(), w.as_py()), Sums(x, reach)
        if block:
            yield done()

    box = pa.list_(pa.float64())
    schema = pa.schema({"job_id": pa.int64(), "block": pa.int64(), "rows": pa.binary(), "x": pa.binary(), "low": box, "high": box})
    return dealt.mapInArrow(run, _BLOCK)
