"""Rows within reach of each other in several dimensions: a join over the leaves of k-d trees.

Every job's space is cut by a tree of its own, split at medians of its widest dimension. A tree is built on the driver from
a bounded sample of rows, which decides where cuts lie and nothing else; the leaves' bounding boxes and sizes are those of
all rows. A row belongs to one leaf and looks into the leaves whose boxes are within reach, so pairs whose boxes are
further apart are never made. A leaf of many rows, such as equal ones, is dealt to keys of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, about, and of a key at most, about; sampled rows for each leaf, and of all jobs together.
LEAF_ROWS, KEY_ROWS, LEAF_SAMPLE, SAMPLE_ROWS = 256, 1024, 16, 1 << 20


@dataclass
class Tree:
    """Inner nodes (dim, value, children) and leaves, numbered by -1 - leaf among the children; lows, highs, keys and rows of leaves."""

    dim: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaves: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    keys: np.ndarray | None = None
    rows: np.ndarray | None = None

    @classmethod
    def built(cls, x: np.ndarray, leaf_sample: int = LEAF_SAMPLE) -> Tree:
        """A tree over sampled points whose leaves hold ``leaf_sample`` of them at most, where they differ."""
        dim, value, child, leaves, todo = [], [], [], 0, [(np.arange(len(x)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            wide = x[own].max(0) - x[own].min(0) if len(own) else np.zeros(x.shape[1])
            d = int(wide.argmax()) if len(wide) else 0
            if len(own) <= leaf_sample or not wide[d] > 0:
                number, leaves = -1 - leaves, leaves + 1
            else:
                at = x[own, d]
                cut = float(np.median(at))
                if cut == at.max():  # the median's equals must not all be on one side
                    cut = float(at[at < cut].max())
                number = len(dim)
                dim.append(d)
                value.append(cut)
                child.append([0, 0])
                todo += [(own[at <= cut], number, 0), (own[at > cut], number, 1)]
            if parent >= 0:
                child[parent][side] = number
        return cls(np.array(dim, np.int64), np.array(value), np.array(child, np.int64).reshape(-1, 2), leaves)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.full(len(x), 0 if len(self.dim) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = self.child[n, (x[inner, self.dim[n]] > self.value[n]).astype(int)]
        return -1 - node

    def within(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of the leaves whose boxes are within reach of each point, a little more for rounding."""
        far = reach * reach * (1 + 1e-9) + 1e-300
        point, node = np.arange(len(x)), np.full(len(x), 0 if len(self.dim) else -1)
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(point):
            done = node < 0
            leaf = -1 - node[done]
            some = x[point[done]]
            apart = np.maximum(np.maximum(self.low[leaf] - some, some - self.high[leaf]), 0.0)
            near = (apart * apart).sum(1) <= far
            out[0].append(point[done][near])
            out[1].append(leaf[near])
            point, node = point[~done], node[~done]
            at = x[point, self.dim[node]] - self.value[node]
            # a child is passed over where the cut alone is out of reach
            left, right = (at <= 0) | (at * at <= far), (at > 0) | (at * at <= far)
            point, node = np.concatenate([point[left], point[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
        return np.concatenate(out[0]), np.concatenate(out[1])


def _points(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)


class Leaves:
    """The trees of the jobs of ``rows`` (job_id, row_id, name0, name1, ...), rows with NaN apart."""

    def __init__(self, rows: DataFrame, dims: int, name: str = "a", leaf_rows: int = LEAF_ROWS):
        names = [f"{name}{d}" for d in range(dims)]
        fine = rows
        for n in names:
            fine = fine.where(~F.isnan(n))
        sizes = {r["job_id"]: r["n"] for r in fine.groupBy("job_id").agg(F.count("*").alias("n")).collect()}
        wanted = max(1, sum(sizes.values()) // leaf_rows * LEAF_SAMPLE)
        step = max(1, leaf_rows // LEAF_SAMPLE) * max(1, -(-wanted // SAMPLE_ROWS))
        sample = fine.where(F.pmod(F.xxhash64("row_id"), F.lit(step)) == 0).select("job_id", *names).toPandas()
        self.trees = {job: Tree.built(np.zeros((0, dims))) for job in sizes}
        self.trees |= {job: Tree.built(some[names].to_numpy(float)) for job, some in sample.groupby("job_id")}
        edges = [f(n).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))]
        for tree in self.trees.values():  # leaves that no row is in are out of everyone's reach
            tree.low, tree.high = np.full((tree.leaves, dims), np.inf), np.full((tree.leaves, dims), -np.inf)
            tree.keys, tree.rows = np.ones(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
        for r in self.placed(fine, names).groupBy("job_id", "cell").agg(F.count("*").alias("n"), *edges).collect():
            tree, leaf = self.trees[r["job_id"]], r["cell"]
            tree.low[leaf], tree.high[leaf] = [r[f"low_{n}"] for n in names], [r[f"high_{n}"] for n in names]
            tree.keys[leaf], tree.rows[leaf] = -(-r["n"] // KEY_ROWS), r["n"]

    def placed(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """``rows`` with the leaf, ``cell``, that each is in."""
        trees = self.trees

        def run(batches):
            for batch in batches:
                jobs, x = batch.column("job_id").to_numpy(), _points(batch, names)
                cell = np.zeros(len(jobs), np.int32)
                for job in np.unique(jobs):
                    own = np.flatnonzero(jobs == job)
                    cell[own] = trees[job].leaf(x[own])
                yield batch.append_column("cell", pa.array(cell))

        return rows.mapInArrow(run, f"{_ddl(rows)}, cell int")

    def looked_into(self, rows: DataFrame, names: list[str], reach: float) -> DataFrame:
        """``rows``, each as often as there are keys of leaves within reach, with ``cell`` and ``key``."""
        trees = self.trees

        def run(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    part = batch.slice(s, 256)
                    jobs, x = part.column("job_id").to_numpy(), _points(part, names)
                    for job in np.unique(jobs):
                        if job not in trees:
                            continue
                        own = np.flatnonzero(jobs == job)
                        point, leaf = trees[job].within(x[own], reach)
                        many = trees[job].keys[leaf]
                        at, end = np.repeat(own[point], many), np.cumsum(many)
                        key = np.arange(len(at)) - np.repeat(end - many, many)
                        found = part.take(pa.array(at))
                        yield found.append_column("cell", pa.array(np.repeat(leaf, many).astype(np.int32))).append_column("key", pa.array(key.astype(np.int64)))

        return rows.mapInArrow(run, f"{_ddl(rows)}, cell int, key long")

    def keyed(self, rows: DataFrame, names: list[str], number: str) -> DataFrame:
        """``rows`` with the leaf that each is in and a key of it, by ``number``."""
        trees = self.trees
        placed = self.placed(rows, names).withColumn("key", F.xxhash64(number))

        def run(batches):
            for batch in batches:
                jobs, cell, key = (batch.column(c).to_numpy() for c in ("job_id", "cell", "key"))
                many = np.ones(len(jobs), np.int64)
                for job in np.unique(jobs):
                    many[jobs == job] = trees[job].keys[cell[jobs == job]]
                yield batch.set_column(batch.schema.get_field_index("key"), "key", pa.array(key % many))

        return placed.mapInArrow(run, _ddl(placed))

    def blocked(self, rows: DataFrame, names: list[str], number: str, size: int) -> DataFrame:
        """``rows`` with ``cell`` and ``block``: leaves that follow each other make a block of about ``size`` rows of a job, a
        larger leaf is dealt to several, by ``number``. Blocks of all jobs are numbered from 0 on."""
        first, many, used = {}, {}, 0
        for job, tree in sorted(self.trees.items()):
            first[job] = used + (np.cumsum(tree.rows) - tree.rows) // size
            many[job] = np.maximum(1, -(-tree.rows // size))
            used = int((first[job] + many[job]).max())
        placed = self.placed(rows, names).withColumn("block", F.xxhash64(number))

        def run(batches):
            for batch in batches:
                jobs, cell, block = (batch.column(c).to_numpy() for c in ("job_id", "cell", "block"))
                at = np.zeros(len(jobs), np.int64)
                for job in np.unique(jobs):
                    own = jobs == job
                    at[own] = first[job][cell[own]] + block[own] % many[job][cell[own]]
                yield batch.set_column(batch.schema.get_field_index("block"), "block", pa.array(at))

        return placed.mapInArrow(run, _ddl(placed))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def near(leaves: Leaves, left: DataFrame, right: DataFrame, dims: int, reach: float, more=None, how: str = "inner") -> DataFrame:
    """Pairs of ``left`` (job_id, row_id, a0, ...) and ``right`` (job_id, other, b0, ...) within reach and with ``more``.

    The right rows are some of those that ``leaves`` was made of; the left ones may be any. Rows with NaN have no pair. With
    ``how`` "left_semi" a left row may come several times.
    """
    for d in range(dims):
        left, right = left.where(~F.isnan(f"a{d}")), right.where(~F.isnan(f"b{d}"))
    left = leaves.looked_into(left, [f"a{d}" for d in range(dims)], reach)
    right = leaves.keyed(right, [f"b{d}" for d in range(dims)], "other")
    far = sum(((F.col(f"a{d}") - F.col(f"b{d}")) * (F.col(f"a{d}") - F.col(f"b{d}")) for d in range(dims)), F.lit(0.0))
    # what looks into many leaves is far larger than the table that it is made of, whose size the planner goes by: without the
    # hint it would broadcast that through the driver
    l, r = left.alias("l"), right.hint("shuffle_hash").alias("r")
    on = (F.col("l.job_id") == F.col("r.job_id")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.key") == F.col("r.key")) & (far <= reach * reach)
    out = l.join(r, on if more is None else on & more, how)
    return out.select("l.*") if how == "left_semi" else out.drop(F.col("r.job_id"), F.col("r.cell"), F.col("r.key")).drop("cell", "key")
