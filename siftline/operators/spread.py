"""Clusterings of jobs too large for one group: a job's rows stay spread over tasks, with ``clustering``'s semantics.

Each function takes features (job_id, row_id, v) that are cheap to read again and gives (job_id, row_id, label,
cluster_count). The driver holds a job's centres, modes or leaders, and the trees of ``neighbours``, only. dbscan's
neighbours come from a join over k-d leaves within reach, where pairs in reach are all made; mean shift adds up what is in
reach over blocks of rows. Either costs a dense place the square of its rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.staging import shuffle_width, staged, unstage
from siftline.operators import clustering as one
from siftline.operators.averages import finite, moved, packed, pieces, unpacked
from siftline.operators.neighbours import Leaves, near

#: Rows of a job in one fold of birch.
FOLD_ROWS = 100_000


def range_number(value: F.Column, cuts: list[int]) -> F.Column:
    """How many of the rising ``cuts`` are below the value: a binary search in one literal."""
    if not cuts:
        return F.lit(0)
    listed, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    below = lambda at, step: F.coalesce(F.get(listed, at + step - 1) < value, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))


def numbered(df: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """``df`` and a column ``name``: a row's number from 0 on among those with its ``part``, by ``order``.

    The first column of ``order``, a whole number, cuts the table into ranges; rows are numbered within a range, after the
    rows of the ranges before. So no task has all rows of a part.
    """
    n = 4 * shuffle_width(df.sparkSession)
    cuts = df.select(F.percentile_approx(F.col(order[0]), [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] or []
    dealt = df.withColumn("_range", range_number(F.coalesce(F.col(order[0]), F.lit(min(cuts, default=0))), sorted(set(cuts))))
    held = dealt.groupBy(part, "_range").agg(F.count("*").alias("_n"))
    # one row per part and range
    before = held.select(part, "_range", (F.sum("_n").over(Window.partitionBy(part).orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(part, "_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(before, [part, "_range"]).withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_range", "_within", "_before")


def _flat(features: DataFrame, dims: int, name: str) -> DataFrame:
    """(job_id, row_id, name0, name1, ...) in doubles; what a shorter vector lacks is 0."""
    return features.select("job_id", "row_id", *(F.coalesce(F.get("v", F.lit(d)).cast("double"), F.lit(0.0)).alias(f"{name}{d}") for d in range(dims)))


def kmeans(features: DataFrame, dims: int, config) -> DataFrame:
    held = features.groupBy("job_id").agg(F.least(F.lit(one.K), F.count("*")).cast("long").alias("cluster_count"))
    return one.spread_kmeans(features).join(held, "job_id")


def gmm(features: DataFrame, dims: int, config, k: int = one.K) -> DataFrame:
    """A round is one grouping of the responsibilities, which are columns."""
    rows = _flat(features, dims, "a")
    sizes = {r["job_id"]: r["n"] for r in rows.groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    first = {(r["job_id"], r["row_id"]): [r[f"a{d}"] for d in range(dims)] for r in rows.where(F.col("row_id") < k).collect()}
    means = {j: [first[j, c % n] for c in range(k)] for j, n in sizes.items()}
    weights = {j: list(one.WEIGHTS[:k]) for j in sizes}

    def shared() -> DataFrame:
        table = rows.sparkSession.createDataFrame([(j, means[j], weights[j]) for j in sizes], "job_id long, means array<array<double>>, weights array<double>")
        out = rows.join(F.broadcast(table), "job_id")
        far = lambda c: sum(((F.col(f"a{d}") - F.col("means")[c][d]) * (F.col(f"a{d}") - F.col("means")[c][d]) for d in range(dims)), F.lit(0.0))
        out = out.withColumns({f"_p{c}": F.col("weights")[c] * F.exp(-0.5 * far(c)) for c in range(k)})
        total = sum((F.col(f"_p{c}") for c in range(1, k)), F.col("_p0"))
        out = out.withColumn("_t", F.when(total == 0, 1.0).otherwise(total))
        return out.withColumns({f"p{c}": F.col(f"_p{c}") / F.col("_t") for c in range(k)})

    for _ in range(one.GMM_ROUNDS - 1):
        sums = [F.sum(f"p{c}").alias(f"h{c}") for c in range(k)] + [F.sum(F.col(f"p{c}") * F.col(f"a{d}")).alias(f"s{c}_{d}") for c in range(k) for d in range(dims)]
        for r in shared().groupBy("job_id").agg(*sums).collect():
            j, held = r["job_id"], [r[f"h{c}"] for c in range(k)]
            weights[j] = [h / sizes[j] for h in held]
            means[j] = [[float(np.float32(r[f"s{c}_{d}"] / (held[c] if held[c] > 0 else 1.0))) for d in range(dims)] for c in range(k)]
    parts = F.array(*(F.col(f"p{c}") for c in range(k)))
    label = (F.array_position(parts, F.array_max(parts)) - 1).cast("int")
    return shared().select("job_id", "row_id", label.alias("label"), F.lit(k).cast("long").alias("cluster_count"))


def dbscan(features: DataFrame, dims: int, config) -> DataFrame:
    """Seeds are dense rows with no earlier seed in reach; a row has its first seed's label, if that isn't later than it.

    In each round every open row without an earlier open one in reach is a seed, and closes those in its reach.
    """
    eps, rows = config.dbscan_eps, _flat(features, dims, "a")
    leaves = Leaves(rows, dims)
    other = lambda df: df.select("job_id", F.col("row_id").alias("other"), *(F.col(f"a{d}").alias(f"b{d}") for d in range(dims)))
    dense = near(leaves, rows, other(rows), dims, eps).groupBy("job_id", "row_id").agg(F.count("*").alias("n")).where(F.col("n") >= config.dbscan_min_samples)
    left, found = staged(rows.join(dense.select("job_id", "row_id"), ["job_id", "row_id"])), []
    while not left.isEmpty():
        later = near(leaves, left, other(left), dims, eps, F.col("other") < F.col("row_id"), "left_semi").select("job_id", "row_id").distinct()
        seeds = staged(left.join(later, ["job_id", "row_id"], "left_anti"))
        closed = near(leaves, left, other(seeds), dims, eps, None, "left_semi").select("job_id", "row_id").distinct()
        left = staged(left.join(closed, ["job_id", "row_id"], "left_anti"))
        found.append(seeds)
    if not found:
        return features.select("job_id", "row_id", F.lit(-1).alias("label"), F.lit(0).cast("long").alias("cluster_count"))
    seeds = staged(numbered(reduce(DataFrame.unionByName, found), "job_id", ["row_id"], "rank"))
    first = near(leaves, rows, other(seeds).join(seeds.select("job_id", F.col("row_id").alias("other"), "rank"), ["job_id", "other"]), dims, eps, F.col("other") <= F.col("row_id"))
    first = first.groupBy("job_id", "row_id").agg(F.min("rank").alias("rank"))
    counts = seeds.groupBy("job_id").agg(F.count("*").alias("cluster_count"))
    out = features.select("job_id", "row_id").join(first, ["job_id", "row_id"], "left").join(counts, "job_id", "left")
    return out.select("job_id", "row_id", F.coalesce("rank", F.lit(-1)).cast("int").alias("label"), F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"))


def mean_shift(features: DataFrame, dims: int, config) -> DataFrame:
    """Six steps over blocks of rows (``averages``); then mode by mode, each the first later row that no mode before reaches."""
    reach, names = 2 * config.dbscan_eps, [f"a{d}" for d in range(dims)]
    points = _flat(features, dims, "a")
    blocks = staged(packed(points, dims))
    parts, tasks = staged(pieces(blocks, dims)), max(1, blocks.count())
    for _ in range(one.SHIFTS):
        before, blocks = blocks, staged(moved(blocks, parts, dims, reach, tasks))
        unstage(before)
    points = staged(unpacked(blocks, dims).unionByName(points.where(~finite(dims))))
    unstage(blocks)
    unstage(parts)
    modes = {r["job_id"]: [] for r in points.select("job_id").distinct().collect()}

    def hit() -> DataFrame:
        table = points.sparkSession.createDataFrame([(j, [p for _, p in m], [i for i, _ in m]) for j, m in modes.items()], "job_id long, modes array<array<double>>, opened array<long>")
        far = lambda m: sum(((F.col(n) - m[d]) * (F.col(n) - m[d]) for d, n in enumerate(names)), F.lit(0.0))
        reached = F.array_position(F.transform("modes", lambda m: far(m) < one.MODE_REACH), True)
        own = F.array_position("opened", F.col("row_id"))
        return points.join(F.broadcast(table), "job_id").withColumn("hit", F.when(own > 0, own).otherwise(reached))

    for _ in range(one.MODES):
        later = hit().where((F.col("hit") == 0) & (F.col("row_id") > F.coalesce(F.array_max("opened"), F.lit(-1))))
        new = later.groupBy("job_id").agg(F.min(F.struct("row_id", *names)).alias("r")).select("job_id", "r.*").collect()
        if not new:
            break
        for r in new:
            modes[r["job_id"]].append((r["row_id"], [r[n] for n in names]))
    label = F.when(F.col("hit") > 0, F.col("hit") - 1).otherwise(F.lit(one.MODES)).cast("int")
    return hit().select("job_id", "row_id", label.alias("label"), F.size("modes").cast("long").alias("cluster_count"))


def birch(features: DataFrame, dims: int, config) -> DataFrame:
    """An ordered fold, FOLD_ROWS rows of every job at a time; eight leaders of a job go from one to the next."""
    eps = config.dbscan_eps
    rows = staged(features.select("job_id", "row_id", "v").repartitionByRange(shuffle_width(features.sparkSession), "row_id"))
    state, parts = {}, []

    def folding(state: dict):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id", kind="stable")
            job = int(pdf["job_id"].iloc[0])
            label, (leaders, held, n) = one.birch_fold(np.stack(pdf["v"].to_list()).astype(float), eps, state.get(job))
            # the state is a row of its own
            return pd.DataFrame(
                {"job_id": job, "row_id": [*pdf["row_id"], -1], "label": [*label, n], "leaders": [*[None] * len(pdf), leaders.ravel().tolist()], "held": [*[None] * len(pdf), held.tolist()]}
            )

        return run

    for start in range(0, rows.agg(F.max("row_id")).first()[0] + 1, FOLD_ROWS):
        some = rows.where((F.col("row_id") >= start) & (F.col("row_id") < start + FOLD_ROWS))
        done = staged(some.groupBy("job_id").applyInPandas(folding(dict(state)), "job_id long, row_id long, label int, leaders array<double>, held array<double>"))
        for r in done.where("row_id = -1").collect():
            state[r["job_id"]] = (np.array(r["leaders"]).reshape(one.LEADERS, -1), np.array(r["held"]), r["label"])
        parts.append(done.where("row_id >= 0").select("job_id", "row_id", "label"))
    counts = rows.sparkSession.createDataFrame([(j, s[2]) for j, s in state.items()], "job_id long, cluster_count long")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(counts), "job_id")


FORMS = {"kmeans++": kmeans, "gmm": gmm, "dbscan": dbscan, "mean_shift": mean_shift, "birch": birch}
